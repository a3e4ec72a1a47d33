"""Vectors held as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b) -> Column:
    """Similarity of unit vectors, clamped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


#: Texts given to an embedder at a time.
EMBED_BATCH = 256


def hashed_words(texts: list[str], size: int = 64) -> list[list[float]]:
    """The embedder at hand offline: signed counts of a text's words in as many cells, at length one."""
    from hashlib import blake2b

    out = []
    for text in texts:
        cells = [0.0] * size
        for word in text.lower().split():
            h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            cells[h % size] += 1.0 if h >> 63 else -1.0
        length = sum(c * c for c in cells) ** 0.5
        out.append([c / length for c in cells] if length else cells)
    return out


def embedded(rows: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]] = hashed_words, batch: int = EMBED_BATCH) -> DataFrame:
    """(key, vector) of every text by an embedder, which gets at most `batch` texts a call; a
    null text has no vector, and an embedder that gives another number of them fails the task."""
    kind = dict(rows.select(key).dtypes)[key]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, batch):
                some = part.slice(at, batch)
                texts = some.column(1).to_pylist()
                given = [t for t in texts if t is not None]
                found = embedder(given) if given else []
                if len(found) != len(given):
                    raise ValueError(f"{len(found)} vectors of {len(given)} texts")
                vectors = iter(found)
                column = pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([some.column(0), column], [key, "vector"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, vector array<double>")


def unit(a) -> Column:
    """The vector at length one; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda v: v.cast("double") / n))


def hybrid(text_score, similarity) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (text_score + similarity) / 2))


def share(value, total) -> Column:
    """value / total, 0 where the total is 0."""
    return F.coalesce(value / F.nullif(total, F.lit(0)), F.lit(0.0))


def rarity_bound(holders) -> Column:
    """Texts a token may be in and still tell holders of a gram apart."""
    return 2 * holders + 1


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): the mean vector of each group at unit length. Means are taken per
    dimension, so that a group of any size is summed by partial aggregates."""
    flat = rows.select(key, F.posexplode(vector).alias("dim", "v"))
    mean = flat.groupBy(key, "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    whole = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("mean"))
    return whole.select(key, unit("mean").alias("centroid"))
