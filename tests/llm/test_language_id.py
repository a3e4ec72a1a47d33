import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import language_id as L
from wakeline.sources.storage import table

from .cases import empty, frame, rows


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert set(held["doc_id"]) == {i for i in got["doc_id"] if zlib.crc32(str(i).encode()) % 5 == 0}
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_backoff_covers_unseen_words():
    known = {"ka": 0, "tz": 1, "e": 2, "^k": 3}
    assert L.cover("katze", known.get) == [3, 0, 1, 2]
    assert L.cover("xyz", known.get) == []
    assert L.mean_score(np.array([[-2, -8], [-4, -9]])) == [-3, -8]


def test_words_are_letters_with_their_marks():
    assert L.words_of("½ ② ² 12 3.5 _") == L.words_of("\u0301 !!") == L.words_of(None) == []
    assert L.words_of("हिन्दी Été a1b") == ["हिन्दी", "été", "a", "b"]
    assert L.words_of("straße, naïve") == ["straße", "naïve"]
    assert [len(w) for w in L.words_of("a" * 150)] == [64, 64, 22]


def slow_words(text):
    kind = lambda c: unicodedata.category(c)[0]
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if kind(c) == "L" or kind(c) == "M" and word:
            word += c
        else:
            out, word = out + ([word] if word else []), ""
    return out


def slow_identify(docs):
    """Whole tables in memory, one word after another."""
    words, grams = {}, {}
    for i, text, lang in docs:
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 5:
            for w in slow_words(text):
                words.setdefault(w, Counter())[lang] += 1
    for w, by in words.items():
        padded = f"^{w}$"
        every = list(w) + [padded[k : k + n] for n in (2, 3, 4) for k in range(len(padded) - n + 1)]
        for g in every:
            for lang, n in by.items():
                grams.setdefault(g, Counter())[lang] += n
    langs = sorted({x for by in words.values() for x in by})

    def scored(table):
        size = {x: sum(by[x] for by in table.values()) for x in langs}
        return {t: [round(math.log((by[x] + 0.5) / (size[x] + 0.5 * len(table))) * (1 << 20)) for x in langs] for t, by in table.items()}

    words, grams = scored(words), scored(grams)
    for i, text, _ in docs:
        total, found = [0] * len(langs), slow_words(text)
        for w in found:
            rows = [words[w]] if w in words else []
            at, padded = 0, f"^{w}$"
            while w not in words and at < len(padded):
                n = next((n for n in (4, 3, 2, 1) if len(padded[at : at + n]) == n and padded[at : at + n] in grams), 0)
                rows += [grams[padded[at : at + n]]] if n else []
                at += max(1, n - 1)
            if rows:
                total = [t + int(np.rint(sum(c) / len(rows))) for t, c in zip(total, zip(*rows))]
        best = max(total, default=0)
        told = (langs[total.index(best)], 1 / sum(math.exp((t - best) / (1 << 20)) for t in total)) if found and langs else ("und", 0.0)
        yield (i, *told)


@pytest.mark.parametrize("bounds", [{}, {"hot_words": 0, "hot_grams": 0}, {"hot_words": 50, "hot_grams": 10**6}])
def test_every_way_equals_brute_force(spark, sf_dir, bounds):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where("doc_id % 2 = 0")
    docs = docs.unionByName(spark.createDataFrame([(10001, "½ ②", None), (10002, "qqzzq xxyx", None), (10003, "हिन्दी", "hi"), (10004, "हिंदी हिन्दी", "hi")], docs.schema))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs, **bounds).collect()}
    want = {i: (lang, score) for i, lang, score in slow_identify([tuple(r) for r in docs.collect()])}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-6 for i in want)


def test_edges(spark):
    got = {r["doc_id"]: r for r in L.identify(frame(spark)).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[8]["lang_pred"] == got[12]["lang_pred"] == "und"
    assert L.identify(frame(spark)).count() == len(rows())
    assert L.identify(empty(spark)).count() == 0
    unlabelled = frame(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in L.identify(unlabelled).collect()} == {"und"}


def test_most_frequent_is_a_bound_for_the_broadcast_alone(spark):
    totals = spark.createDataFrame([(f"w{i}", 1 << (i % 12)) for i in range(1200)], "term string, total long")
    kept = L.most_frequent(totals, 350).toPandas()
    assert len(kept) == 300 and kept["total"].min() == 512
    assert L.most_frequent(totals, 50).count() == 0
