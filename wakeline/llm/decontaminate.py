"""Benchmark decontamination with one Aho-Corasick automaton (operator 9).

Text is folded to words: A-Z lower-cased, a word being a run of digits, letters a-z and
any non-ASCII characters. Benchmark items become windows of ten consecutive words (an
item with fewer words is one window). The automaton holds every distinct window once;
each text is scanned once, and hits are mapped back to word ranges and to character
offsets of the original text.

The automaton is sent to tasks, so its size is checked first: windows are dealt by hash
into as many parts as keep each under `PART_BYTES`, and written so; each part in turn is
read, scans the texts on its own and is dropped before the next. Hits of all parts are then
merged by row of a written copy of the documents. No window is left out.

Defined results: null and empty texts have no words and no hits; an item without words
has no window and is never found; equal windows of several items count for each of
them; items without an id mark words as hit and count as one item, listed as null; repeated documents are judged alike; other input columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, as_longs, as_texts, new_path, staged

WINDOW = 10
PART_BYTES = 8 << 20

# Bytes of words keep their value, lower-cased; all other bytes become spaces. Bytes from
# 0x80 on only occur in non-ASCII characters, so words of bytes are words of characters.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def windows_of(text: str | None, width: int = WINDOW) -> list[str]:
    """Each distinct window once, its words joined by spaces, bytes shown as Latin-1."""
    words = [w.decode("latin-1") for w in fold(text)]
    if not words:
        return []
    return list(dict.fromkeys(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))))


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Rows (window, item_ids): every distinct window with the items that hold it, ids as
    text, that of items without an id being empty."""

    def explode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            pairs = [(w, i) for i, t in zip(part["item_id"], part["text"], strict=True) for w in windows_of(t, width)]
            yield pd.DataFrame(pairs, columns=["window", "item_id"])

    ids = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    rows = benchmark.select(ids, "text").mapInPandas(explode, "window string, item_id string")
    return rows.groupBy("window").agg(F.collect_set("item_id").alias("item_ids"))


def automaton(patterns: list[tuple[str, list[str]]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (window, items) in enumerate(patterns):
        # Spaces on both sides keep hits on word boundaries.
        found.add_word(f" {window} ", (window.count(" ") + 1, k, items))
    found.make_automaton()
    return found


def scan(text: str | None, machine) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, merged word ranges [start, end) of hits, items found."""
    words = fold(text)
    if not words or not len(machine):
        return len(words), [], set()
    line = f" {b' '.join(words).decode('latin-1')} "
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    seen: set[int] = set()
    at = last = 0
    for end, (n, k, ids) in machine.iter(line):
        # `end` is the space after the window's last word; spaces before it count words.
        at += line.count(" ", last, end)
        last = end
        ranges.append((at - n, at))
        if k not in seen:
            seen.add(k)
            items.update(ids)
    return len(words), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of the original text under word ranges."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


HITS = "doc_id string, n_words long, words array<struct<start:long,end:long>>, spans array<struct<start:long,end:long>>, items array<string>"


def _sent(windows: DataFrame):
    """Broadcast of (window, sorted item ids)."""
    return windows.sparkSession.sparkContext.broadcast([(r["window"], sorted(r["item_ids"])) for r in windows.collect()])


def _scan_part(docs: DataFrame, sent) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton(sent.value)
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                n, ranges, items = scan(text, machine)
                spans = original_spans(text, ranges) if ranges else []
                as_rows = lambda x: [{"start": a, "end": b} for a, b in x]
                rows.append((doc_id, n, as_rows(ranges), as_rows(spans), sorted(items)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "words", "spans", "items"])

    arrow_rows(docs.sparkSession)
    return as_texts(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, HITS)


def _merge(spans: str) -> F.Column:
    """Merge sorted ranges that touch or overlap."""
    return F.expr(
        f"aggregate(array_sort({spans}), cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) -> "
        "CASE WHEN size(a) > 0 AND x.start <= element_at(a, -1).end THEN "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, "
        "'end', greatest(element_at(a, -1).end, x.end)))) ELSE concat(a, array(x)) END)"
    )


def _with_longs(found: DataFrame) -> DataFrame:
    """Ids back as numbers; that of items without an id is null and comes last."""
    return as_longs(found, "doc_id").withColumn("items", F.array_sort(F.transform("items", lambda x: F.when(x != "", x).cast("long"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: n_words, hit word ranges, hit character spans, ids of items found."""
    windows = item_windows(benchmark, width)
    total = windows.agg(F.sum(F.length("window") + 16 + 8 * F.size("item_ids"))).first()[0] or 0
    n_parts = max(1, -(-int(total) // part_bytes))
    if n_parts == 1:
        return _with_longs(_scan_part(docs, _sent(windows)))
    spark = docs.sparkSession
    parts, hits = new_path(spark, "benchmark-windows"), new_path(spark, "benchmark-hits")
    part = F.pmod(F.xxhash64("window"), F.lit(n_parts)).cast("int").alias("part")
    windows.select("*", part).repartition(n_parts, "part").write.partitionBy("part").parquet(parts)
    # Written, so that every part sees the same row ids: a doc_id may repeat or be null.
    rows, _ = staged(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "benchmark-documents")
    texts = rows.select(F.col("row").alias("doc_id"), "text")
    dealt = spark.read.schema("window string, item_ids array<string>, part int").parquet(parts)
    for k in range(n_parts):
        sent = _sent(dealt.where(F.col("part") == k))
        found = _scan_part(texts, sent)
        # The first part keeps every row, for its words.
        (found.where("size(words) > 0") if k else found).write.mode("append").parquet(hits)
        sent.destroy()
    found = as_longs(spark.read.schema(HITS).parquet(hits).withColumnRenamed("doc_id", "row"), "row").groupBy("row").agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("words")).alias("words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged_rows = rows.select("row", "doc_id").join(found.withColumns({"words": _merge("words"), "spans": _merge("spans")}), "row")
    return _with_longs(merged_rows.select("doc_id", "n_words", "words", "spans", "items"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's rows."""
    hit = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )

