"""Language identification by words first, backing off to shorter n-grams (operator 6).

Training counts words per language over all labelled training documents, and character
n-grams of orders 4 to 1 over those words. A known word scores by its smoothed log
frequency in each language. An unseen word is covered from left to right by the longest
known n-grams, and scores the mean of their log frequencies, as one word.

The model is two tables, of words and of n-grams, as long as the corpus makes them; nothing
is cut from them. The most frequent words, at most `HOT_WORDS`, are broadcast and scored
where the text is read; a document's other words go through a join with the word table,
and words that it lacks are covered by n-grams, which are broadcast if at most `HOT_GRAMS`
exist and joined otherwise. Scores are whole numbers of 2^-20, so their sums do not depend
on the order, and every way gives the same result.

A word is a letter (Unicode category L) with the letters and marks (M) that follow it; a run
of over 64 counts as several words.

Defined results: a text that is null or has no letter is `und` with score 0, and so is
every text if no document is labelled; ties between languages go to the first by name; a
null doc_id is neither held out nor trained on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, checkpoint, remove, staged

ORDERS = (4, 3, 2, 1)
HOT_WORDS = 200_000
HOT_GRAMS = 300_000
FLUSH = 300_000
ALPHA = 0.5
SCALE = 1 << 20
# Lower-cased texts up to U+024F have these letters and no marks; others go by category.
LATIN = re.compile("[a-zªµºß-öø-ɏ]{1,64}")
BEYOND = re.compile("[^\x00-ɏ]")
ANY = r"\p{L}[\p{L}\p{M}]{0,63}"
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if not BEYOND.search(text):
        return LATIN.findall(text)
    import regex

    return regex.findall(ANY, text)


def grams_of(word: str, order: int) -> list[str]:
    padded = f"^{word}$" if order > 1 else word
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def cover(word: str, known: Callable[[str], object]) -> list:
    """What is known of the longest n-grams from left to right."""
    padded, at, found = f"^{word}$", 0, []
    while at < len(padded):
        for order in ORDERS:
            k = known(padded[at : at + order]) if at + order <= len(padded) else None
            if k is not None:
                found.append(k)
                at += max(1, order - 1)
                break
        else:
            at += 1
    return found


def mean_score(rows: np.ndarray) -> list[int]:
    return np.rint(rows.sum(axis=0) / len(rows)).astype(np.int64).tolist()


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _flushed(held: dict[str, Counter], least: int) -> Iterator[pd.DataFrame]:
    """Send (lang, term, n) on once there are so many in this task."""
    if held and sum(map(len, held.values())) >= least:
        for lang, counts in held.items():
            if not counts:
                continue
            yield pd.DataFrame({"lang": lang, "term": list(counts), "n": list(counts.values())})
        held.clear()


def count_words(docs: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for part in parts:
            for lang, text in zip(part["lang"], part["text"], strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
            yield from _flushed(held, FLUSH)
        yield from _flushed(held, 1)

    rows = docs.select("lang", "text").mapInPandas(run, "lang string, term string, n long")
    return rows.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for part in parts:
            for lang, word, n in zip(part["lang"], part["term"], part["n"], strict=True):
                counts = held.setdefault(lang, Counter())
                for order in ORDERS:
                    for g in grams_of(word, order):
                        counts[g] += n
            yield from _flushed(held, FLUSH)
        yield from _flushed(held, 1)

    rows = words.mapInPandas(run, "lang string, term string, n long")
    return rows.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def scores(counts: DataFrame, languages: list[str]) -> DataFrame:
    """(term, v, total): smoothed log frequency in every language, in whole 2^-20."""
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    by_term = counts.groupBy("term").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("total")
    )
    terms = counts.select("term").distinct().count()
    each = [
        F.round(F.log((F.coalesce(F.col("by")[F.lit(x)], F.lit(0)) + ALPHA) / (sizes.get(x, 0) + ALPHA * max(1, terms))) * SCALE).cast("long")
        for x in languages
    ]
    return by_term.select("term", F.array(*each).alias("v"), "total")


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """Terms of the largest totals, at most `most`; those of like totals stay or go together."""
    bucket = F.floor(F.log2("total") * 8)
    sizes = sorted(((r["b"], r["count"]) for r in table.groupBy(bucket.alias("b")).count().collect()), reverse=True)
    total, least = 0, None
    for b, n in sizes:
        total += n
        if total > most:
            break
        least = b
    return table.where(F.lit(False)) if least is None else table.where(bucket >= least)


@dataclass
class Model:
    languages: list[str]
    words: DataFrame  # term, v, total
    grams: DataFrame
    paths: list[str]

    def drop(self) -> None:
        for path in self.paths:
            remove(self.words.sparkSession, path)


def train(docs: DataFrame) -> Model:
    """Learn from every row of docs (text, lang) that has a language."""
    spark = docs.sparkSession
    arrow_rows(spark)
    counted, counted_at = staged(count_words(docs.where("lang IS NOT NULL AND text IS NOT NULL")), "language-words")
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    arrow_rows(spark, 20_000)
    parts = 4 * spark.sparkContext.defaultParallelism
    gram_counts, grams_at = staged(count_grams(counted.repartition(parts, "term")), "language-grams")
    words, words_to = staged(scores(counted, languages), "language-word-scores")
    grams, grams_to = staged(scores(gram_counts, languages), "language-gram-scores")
    remove(spark, counted_at)
    remove(spark, grams_at)
    return Model(languages, words, grams, [words_to, grams_to])


def _table(rows: DataFrame, languages: int) -> tuple[dict[str, int], np.ndarray]:
    found = rows.select("term", "v").toArrow()
    terms = found.column("term").to_pylist()
    v = found.column("v").combine_chunks()
    matrix = np.asarray(v.flatten() if len(terms) else [], dtype=np.int64).reshape(len(terms), languages)
    return {t: i for i, t in enumerate(terms)}, matrix


PARTIAL = "_row long, _words long, _known array<long>, _rest array<struct<term: string, n: long>>"


def _known_words(rows: DataFrame, key: str, hot: tuple[dict[str, int], np.ndarray]) -> DataFrame:
    """Per row its key, its words, the sum over its frequent words, and its other words."""
    # Plain values: broadcasts are unpickled where this package may not be installed.
    sent = rows.sparkSession.sparkContext.broadcast(hot)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, matrix = sent.value
        for part in parts:
            size, known, ends, terms, counts = [], [], [0], [], []
            for text in part.column("text"):
                found = Counter(words_of(text.as_py()))
                places = np.fromiter((at.get(w, -1) for w in found), dtype=np.int64, count=len(found))
                n = np.fromiter(found.values(), dtype=np.int64, count=len(found))
                size.append(int(n.sum()))
                known.append(n[places >= 0] @ matrix[places[places >= 0]])
                rest = [w for w, p in zip(found, places.tolist(), strict=True) if p < 0]
                terms += rest
                counts += [found[w] for w in rest]
                ends.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=["term", "n"])
            told = [
                part.column("_row"), pa.array(size, pa.int64()), pa.array(known, pa.list_(pa.int64())),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
            ]
            yield pa.RecordBatch.from_arrays([part.column(key), *told], [key, "_row", "_words", "_known", "_rest"])

    arrow_rows(rows.sparkSession)
    schema = f"`{key}` {dict(rows.dtypes)[key]}, {PARTIAL}"
    return rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(run, schema)


def _unseen_scores(terms: DataFrame, model: Model, hot_grams: int) -> DataFrame:
    """(term, v) of the terms that hold known n-grams."""
    arrow_rows(terms.sparkSession, 20_000)
    if model.grams.count() <= hot_grams:
        sent = terms.sparkSession.sparkContext.broadcast(_table(model.grams, len(model.languages)))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, matrix = sent.value
            for part in parts:
                found = [(w, cover(w, at.get)) for w in part["term"]]
                yield pd.DataFrame([(w, mean_score(matrix[k])) for w, k in found if k], columns=["term", "v"])

        return terms.mapInPandas(run, "term string, v array<long>")

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(w, g) for w in part["term"] for g in {g for order in ORDERS for g in grams_of(w, order)} | set(w)]
            yield pd.DataFrame(rows, columns=["term", "gram"])

    def covered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for word, held in zip(part["term"], part["held"], strict=True):
                known = {x["gram"]: x["v"] for x in held}
                rows.append((word, mean_score(np.array(cover(word, known.get), dtype=np.int64))))
            yield pd.DataFrame(rows, columns=["term", "v"])

    split_terms = terms.mapInPandas(split, "term string, gram string")
    held = split_terms.join(model.grams.select(F.col("term").alias("gram"), "v"), "gram")
    # At most 260 n-grams to a term, as a word has 64 letters at most.
    by_term = held.groupBy("term").agg(F.collect_list(F.struct("gram", "v")).alias("held"))
    return by_term.mapInPandas(covered, "term string, v array<long>")


def predict(docs: DataFrame, model: Model, key: str = "doc_id", hot_words: int = HOT_WORDS, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """The key, lang_pred and score of every document, from its text alone."""
    rows = docs.select(key, "text")
    if not model.languages:
        return rows.select(key, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    hot = _table(most_frequent(model.words, hot_words), len(model.languages))
    read, read_at = staged(_known_words(rows, key, hot), "language-rows")
    rest = read.select("_row", F.explode("_rest").alias("r")).select("_row", "r.term", "r.n")
    terms = rest.select("term").distinct()
    seen = terms.join(model.words.select("term", "v"), "term")
    unseen = terms.join(model.words.select("term"), "term", "left_anti")
    found, found_at = staged(seen.unionByName(_unseen_scores(unseen, model, hot_grams)), "language-terms")
    each = range(len(model.languages))
    sums = rest.join(found, "term").groupBy("_row").agg(*[F.sum(F.col("n") * F.col("v")[i]).alias(f"_s{i}") for i in each])
    sums = sums.select("_row", F.array(*[f"_s{i}" for i in each]).alias("_sums"))
    total = F.when(F.col("_sums").isNull(), F.col("_known")).otherwise(F.zip_with("_known", "_sums", lambda a, b: a + b))
    best = F.array_max("_total")
    odds = F.aggregate("_total", F.lit(0.0), lambda a, x: a + F.exp((x - best) / float(SCALE)))
    told = read.drop("_rest").join(sums, "_row", "left").withColumn("_total", total)
    named = F.array(*[F.lit(x) for x in model.languages])
    lang = F.when(F.col("_words") > 0, F.element_at(named, F.array_position("_total", best).cast("int"))).otherwise(UNKNOWN)
    out = checkpoint(told.select(key, lang.alias("lang_pred"), F.when(F.col("_words") > 0, 1 / odds).otherwise(F.lit(0.0)).alias("score")))
    for path in (read_at, found_at):
        remove(docs.sparkSession, path)
    return out


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """Train on the four fifths that are not held out and predict every document."""
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("text", "lang"))
    out = predict(docs, model, **bounds).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
    model.drop()
    return out
