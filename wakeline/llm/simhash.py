"""SimHash near-duplicates with Golay-code fuzzy keys (operator 4).

A fingerprint has a bit set where more than half of the text's shingle hashes have it.
Two fingerprints link at two or fewer differing bits.

Candidates. The 64 bits are three segments of 22, 21 and 21 bits. At most two errors
leave one segment (i) free of errors and its successor (j) with at most one, whichever
way they fall: errors (2,0,0) leave i=1, j=2; (1,1,0) leaves i=2, j=0; and so on in turn.
Segment j is padded to the 23 bits of the binary Golay code and decoded to every codeword
at distance 4 or less: 1 index if it lies within 2 of a codeword, else 6. If two words
differ in one bit, the codeword nearest to one (at most 3 away, as the code is perfect)
is at most 4 from the other, so they share an index. A key is (i, segment i, index of j),
34 bits, and each fingerprint has 3 to 18 of them. Verification follows, so no link is
lost and none is invented.

Skew. Only distinct fingerprints take part, so copies never meet as pairs. Buckets of at
most `PAIRS_UP_TO` fingerprints compare theirs within the row; the fingerprints of larger
buckets are instead each sent to their 65 neighbours at distance 0 or 1, as two
fingerprints link exactly if they share such a neighbour. A neighbour has at most 65
fingerprints, so that way is exact and no group of it is large.

Defined results: a text without words, or null, has fingerprint zero and links like any
other; with fewer words than a shingle the whole sequence is the one shingle; repeated
rows keep a row each; a null doc_id never names a component; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.components import components

from .common import arrow_rows, as_longs, as_texts, checkpoint

SHINGLE = 3
SEED = 42
DISTANCE = 2
PAIRS_UP_TO = 64
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)

# Generator polynomial of the binary Golay code [23, 12, 7].
GOLAY = 0b110001110101


def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and the error pattern of each remainder."""
    power = [0] * 23
    r = 1
    for b in range(23):
        power[b] = r
        r <<= 1
        if r >> 11:
            r ^= GOLAY
    rest = lambda x, base: np.bitwise_xor.reduce([power[base + b] for b in range(12) if x >> b & 1] or [0])
    low = np.array([rest(x, 0) for x in range(1 << 12)], dtype=np.int64)
    high = np.array([rest(x, 12) for x in range(1 << 11)], dtype=np.int64)
    leader = np.zeros(1 << 11, dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            leader[np.bitwise_xor.reduce([power[b] for b in bits])] = sum(1 << b for b in bits)
    return low, high, leader


def golay_indices(words: np.ndarray, tables=None) -> np.ndarray:
    """[n, 24] indices of the codewords at distance 4 or less; -1 where one repeats."""
    low, high, leader = tables or _golay_tables()
    flips = np.array([0, *(1 << b for b in range(23))], dtype=np.int64)
    near = words[:, None] ^ flips
    found = np.sort((near ^ leader[low[near & 0xFFF] ^ high[near >> 12]]) >> 11, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def fuzzy_keys(prints: np.ndarray, tables=None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint."""
    tables = tables or _golay_tables()
    parts = [((prints.astype(np.uint64) >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        index = golay_indices(parts[(i + 1) % 3], tables)
        key = (i << 34) | (parts[i][:, None] << 12) | index
        row, col = np.nonzero(index >= 0)
        rows.append(row)
        keys.append(key[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def hashes_of(shingles: Iterable[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64)


def print_of(parts: Iterable[np.ndarray]) -> int:
    """Signed fingerprint of shingle hashes, given some at a time."""
    n, set_ = 0, np.zeros(64, dtype=np.int64)
    for h in parts:
        n += len(h)
        set_ += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n).view(">i8")[0])


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    cuts = (range(at, min(n, at + (1 << 15))) for at in range(0, n, 1 << 15))
    return print_of(hashes_of(b" ".join(words[i : i + width]) for i in cut) for cut in cuts)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "fp": [fingerprint(t, width) for t in part["text"]]})

    arrow_rows(docs.sparkSession)
    rows = as_texts(docs.select("doc_id", "text"), "doc_id")
    return as_longs(rows.mapInPandas(run, "doc_id string, fp long"), "doc_id")


def _keys(prints: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _golay_tables()
        for part in parts:
            row, key = fuzzy_keys(part["fp"].to_numpy().view(np.uint64), tables)
            yield pd.DataFrame({"key": key, "fp": part["fp"].to_numpy()[row], "node": part["node"].to_numpy()[row]})

    return prints.mapInPandas(run, "key long, fp long, node long")


def links(prints: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Edges (u, v) that connect all fingerprints linked to each other; rows (fp, node)."""
    arrow_rows(prints.sparkSession, 20_000)
    keys = _keys(prints)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = checkpoint(keys.join(sizes, "key"))
    small = sized.where(F.col("n") <= pairs_up_to).groupBy("key").agg(F.collect_list(F.struct("fp", "node")).alias("m"))
    met = small.select(
        F.explode(
            F.expr(
                "flatten(transform(m, (a, i) -> transform(filter(slice(m, i + 2, size(m)), "
                f"b -> bit_count(a.fp ^ b.fp) <= {DISTANCE}), b -> struct(a.node AS u, b.node AS v))))"
            )
        ).alias("e")
    ).select("e.u", "e.v")
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    near = (
        sized.where(F.col("n") > pairs_up_to)
        .select("fp", "node")
        .distinct()
        .select("node", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("z"))
    )
    stars = near.groupBy("z").agg(F.min("node").alias("v"), F.collect_list("node").alias("all")).where(F.size("all") > 1)
    return met.unionByName(stars.select(F.explode("all").alias("u"), "v").where("u <> v"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id reachable over links."""
    prints = checkpoint(fingerprints(docs, width))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    roots = components(links(nodes.where("node IS NOT NULL"), pairs_up_to))
    labels = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
