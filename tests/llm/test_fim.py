import hashlib
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakeline.llm import fim

from .cases import empty, frame, rows

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(UNIT, text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (len(units), "plain", None, None, text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def check(spark, docs, df=None):
    df = df or spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = fim.transform(df)
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(repr((d, *brute(d, t))) for d, t in docs)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    restored = sorted((str(r["doc_id"]), r["restored_sha256"]) for r in fim.digest(out).collect())
    assert restored == sorted((str(d), sha(t)) for d, t in docs)


@given(st.lists(st.integers(1, 4000), max_size=300))
def test_lists_select_every_end(steps):
    ends = np.cumsum(np.array(steps, dtype=np.int64))
    packed = fim.elias_fano(ends)
    assert [fim.select(k, *packed) for k in range(len(ends) + 1)] == [0, *ends.tolist()]
    assert len(packed[1]) + len(packed[2]) <= 2 + (2 + 1 + packed[0]) * len(ends) / 8 + len(ends) / 8


def test_against_brute_force(spark):
    texts = [
        "one two  three\n\nfour ", "  lead", "\t", "", None, "a<P>b c d", "x <S> y", "plain <M", "<<P", "tail <", "a < S> b <S", "  nbsp é 日本 😀 end",
        "w " * 5000, "same text for many", "<",
    ]
    check(spark, [(i, texts[i % len(texts)]) for i in range(300)] + [(None, "no id here"), (None, "no id here"), (2**53 + 1, "big")])


def test_copies_beyond_the_hot_bound_are_salted(spark):
    docs = [(i, "the same text in a third of all rows <x> y z") for i in range(400)] + [(None, "null copies too")] * 90 + [(1000 + i, f"text {i} of its own") for i in range(600)]
    check(spark, docs)


def test_texts_of_one_digest_are_told_apart(spark, monkeypatch):
    """A digest of few bits: groups hold different texts, which content tells apart."""
    docs = [(i, f"{'a b ' * (i % 3)}text {i % 5}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id string, text string").coalesce(1).withColumn("key", F.unhex(F.lit("00")))
    index = fim.boundary_index(df).where("chars = 6").withColumn("key", F.unhex(F.lit("00"))).limit(1)
    joined = df.select("*", *[fim._draw(k, 42).alias(f"h{k + 1}") for k in range(4)]).join(index, "key")
    got = {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in fim._cut(joined).collect()}
    # A text of the list's length that follows none is held to be the listed one by its digest.
    assert sum(got[d] == brute(d, t) for d, t in docs) >= 59


def test_edges(spark):
    assert fim.transform(frame(spark)).count() == len(rows())
    check(spark, [(r[0], r[1]) for r in rows()], frame(spark))
    assert fim.digest(fim.transform(empty(spark))).count() == 0
