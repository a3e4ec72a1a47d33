"""Fill-in-the-middle over an index of distinct texts (operator 13).

A text is cut into units, a run of white space with the word after it each. The ends of a
text's units rise, so they are kept as an Elias-Fano list: the low bits of every end side by
side, and the high bits as a unary string in which the k-th one bit stands for the k-th end.
An end is selected by a running count of one bits, without unpacking the list.

Index. `boundary_index` gives one row per distinct text, keyed by its SHA-256: units, ends,
whether a marker stands in it. A task makes the list of a text once and passes its copies as
bare keys; one list per text then goes on. Documents are joined to it by key, and every
seeded cut selects two ends. Grouping is checked by content: texts of one key that follow
each other are compared, and one that differs, or has another length than its list, is cut
by a list of its own.

Skew. Texts with more copies than a ten-thousandth of all rows are at most ten thousand, so
they are broadcast as a list of keys; their documents are dealt over salts of which each has
a copy of the text's list. Texts are shuffled once, lists once.

Defined results: a null or empty text has no units and stays plain; a text that contains
`<P>`, `<S>` or `<M>` stays plain; repeated rows keep a row each; a null doc_id is cut as an
empty one; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, as_longs, as_texts, checkpoint

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
SEED = 42
#: Shares, in percent, of texts that are rearranged, and of those that put the suffix first.
CUT, SPM = 50, 80
HOT_LEAST = 64
HOT_SHARE = 10_000
#: Digests a task remembers; lists made again after it forgot them are dropped by key.
REMEMBERED = 1 << 18
ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)


def unit_ends(text: str) -> np.ndarray:
    """Code points up to the end of every unit."""
    return np.fromiter((m.end() for m in UNIT.finditer(text)), dtype=np.int64)


def elias_fano(ends: np.ndarray) -> tuple[int, bytes, bytes]:
    """(low bits per end, high part, low part) of a rising list."""
    if not len(ends):
        return 0, b"", b""
    width = max(0, (int(ends[-1]) // len(ends)).bit_length() - 1)
    high = np.zeros((int(ends[-1]) >> width) + len(ends), dtype=np.uint8)
    high[(ends >> width) + np.arange(len(ends))] = 1
    low = (ends[:, None] >> np.arange(width) & 1).astype(np.uint8).reshape(-1)
    return width, np.packbits(high, bitorder="little").tobytes(), np.packbits(low, bitorder="little").tobytes()


def select(k: int, width: int, high: bytes, low: bytes) -> int:
    """The end of the first k units; 0 of none."""
    if k == 0:
        return 0
    raw = np.frombuffer(high, dtype=np.uint8)
    ones = np.cumsum(ONES[raw])
    at = int(np.searchsorted(ones, k))
    rest = k - (int(ones[at - 1]) if at else 0)
    bit = int(np.flatnonzero(np.unpackbits(raw[at : at + 1], bitorder="little"))[rest - 1])
    first = (k - 1) * width
    some = int.from_bytes(low[first // 8 : (first + width + 7) // 8], "little")
    return (8 * at + bit - (k - 1)) << width | some >> first % 8 & (1 << width) - 1


INDEX = "key binary, n long, chars long, marked boolean, width int, high binary, low binary"


def boundary_index(texts: DataFrame) -> DataFrame:
    """One row per distinct text of column text: key, units, code points, marked, its list."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for part in parts:
            rows = []
            for text in part["text"]:
                key = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                if key in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                ends = unit_ends(text)
                rows.append((key, len(ends), len(text), any(m in text for m in MARKERS), *elias_fano(ends)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])

    arrow_rows(texts.sparkSession)
    return texts.select("text").mapInPandas(run, INDEX).dropDuplicates(["key"])


def _draw(k: int, seed: int) -> Column:
    """The k-th of the numbers drawn for a document from the digest of its seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("doc_id", F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")


CUTS = "doc_id string, n long, form string, prefix_chars long, middle_chars long, output string"


def _cut(joined: DataFrame) -> DataFrame:
    """Select both ends of every document's cut and put its text together."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first = None, None
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                text = r.text
                if r.key != key:
                    key, first = r.key, text
                n, marked, ends = r.n, r.marked, (r.width, r.high, r.low)
                if text != first or len(text) != r.chars:
                    own = unit_ends(text)
                    n, marked, ends = len(own), any(m in text for m in MARKERS), elias_fano(own)
                if not text or marked or r.h3 % 100 >= CUT:
                    rows.append((r.doc_id, n, "plain", None, None, text))
                    continue
                a, b = sorted((r.h1 % (n + 1), r.h2 % (n + 1)))
                a, b = select(a, *ends), select(b, *ends)
                form = "spm" if r.h4 % 100 < SPM else "psm"
                head, tail = f"{PREFIX}{text[:a]}", f"{SUFFIX}{text[b:]}"
                both = tail + head if form == "spm" else head + tail
                rows.append((r.doc_id, n, form, a, b - a, f"{both}{MIDDLE}{text[a:b]}"))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in CUTS.split(", ")])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    arrow_rows(joined.sparkSession)
    return as_longs(joined.mapInPandas(run, CUTS), "doc_id")


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: units, form, code points of prefix and middle, and the text as put out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = as_texts(docs.select("doc_id", text.alias("text")), "doc_id").withColumn("key", F.unhex(F.sha2("text", 256)))
    drawn = rows.select("*", *[_draw(k, seed).alias(f"h{k + 1}") for k in range(4)])
    hot_from = max(HOT_LEAST, docs.count() // HOT_SHARE)
    # Keys of more than one in `HOT_SHARE` rows: so many at most.
    hot = checkpoint(rows.groupBy("key").count().where(F.col("count") > hot_from).select("key", F.ceil(F.col("count") / hot_from).alias("salts")))
    cold = drawn.join(F.broadcast(hot), "key", "left_anti")
    found = _cut(cold.join(boundary_index(cold), "key"))
    if not hot.count():
        return found
    many = drawn.join(F.broadcast(hot), "key").withColumn("salt", F.pmod(F.monotonically_increasing_id(), "salts"))
    lists = boundary_index(many).join(F.broadcast(hot), "key").withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).drop("salts")
    return found.unionByName(_cut(many.drop("salts").join(lists, ["key", "salt"])))


def restore(output: Column, form: Column) -> Column:
    """The text that was put out in a form."""

    def between(start: str | None, stop: str | None) -> Column:
        some = output if start is None else F.substring(output, F.instr(output, start) + 3, F.length(output))
        return some if stop is None else F.substring(some, F.lit(1), F.instr(some, stop) - 1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(found: DataFrame) -> DataFrame:
    whole = restore(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"),
    )
