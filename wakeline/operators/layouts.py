"""A two-dimensional layout that keeps neighbours near, and new rows placed in it.

The frame is laid out from at most `MAX_POINTS` vectors, chosen by a hash of their ids: Spark
tasks find every point's nearest ones; weights fall with distance beyond the nearest, scaled
so that each point has the same sum of weights; and positions, begun at the plane of greatest
variance, are moved by seeded steps in which neighbours draw together and points met by chance
push apart. The frame is a table (id, vector, x, y): it is stored with its version, and rows
that come later are placed among their nearest in it, each on its own, so nothing ever moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.vectors import unit

from .density import BLOCK, MAX_POINTS, _blocks

NEIGHBOURS, EPOCHS, CHANCES, SEED = 15, 200, 5, 42
#: The curve of nearness in the plane, 1 / (1 + A d^2B), for points that may all but touch.
A, B = 1.58, 0.9


def _nearest(x: np.ndarray, of: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k rows of x nearest to each row, nearest first, equal ones in order."""
    found = np.sqrt(np.maximum(2 - 2 * of @ x.T, 0)).round(12)
    if skip is not None:
        found[np.arange(len(of)), skip] = np.inf
    order = np.argsort(found, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(found, order, axis=1)


def weights(distances: np.ndarray) -> np.ndarray:
    """Weights of neighbours (rows, nearest first): 1 for the nearest, the rest scaled to one sum."""
    beyond, goal = distances - distances[:, :1], np.log2(max(2, distances.shape[1]))
    low, high = np.full(len(distances), 1e-9), np.full(len(distances), 1e3)
    for _ in range(64):
        middle = np.sqrt(low * high)
        over = np.exp(-beyond / middle[:, None]).sum(axis=1) > goal
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    return np.exp(-beyond / np.sqrt(low * high)[:, None])


def _positions(x: np.ndarray, near: np.ndarray, weight: np.ndarray, seed: int) -> np.ndarray:
    n = len(x)
    rng = np.random.default_rng(seed)
    middle = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(middle, full_matrices=False)
    # The sign of an axis is free: its largest part is made positive, so that reruns agree.
    axes = axes[:2] * np.sign(axes[:2][np.arange(len(axes[:2])), np.abs(axes[:2]).argmax(axis=1)])[:, None]
    flat = middle @ axes.T
    at = 10 * np.pad(flat, ((0, 0), (0, 2 - flat.shape[1]))) / max(1e-9, np.abs(flat).max())
    at = at + 1e-4 * rng.standard_normal(at.shape)
    # A pair is as near as either side finds it.
    both: dict[tuple[int, int], float] = {}
    for i, (js, ws) in enumerate(zip(near.tolist(), weight.tolist(), strict=True)):
        for j, w in zip(js, ws, strict=True):
            key = (min(i, j), max(i, j))
            both[key] = both.get(key, 0.0) + w - both.get(key, 0.0) * w
    ends, strength = np.array(sorted(both)), np.array([both[k] for k in sorted(both)])
    for epoch in range(EPOCHS):
        rate = 1 - epoch / EPOCHS
        u, v = ends[rng.random(len(ends)) < strength].T
        gap = at[u] - at[v]
        d2 = np.maximum((gap**2).sum(axis=1), 1e-12)
        pull = np.clip((-2 * A * B * d2 ** (B - 1) / (1 + A * d2**B))[:, None] * gap, -4, 4)
        move = np.zeros_like(at)
        np.add.at(move, u, pull)
        np.add.at(move, v, -pull)
        i, j = np.repeat(u, CHANCES), rng.integers(0, n, CHANCES * len(u))
        gap = at[i] - at[j]
        d2 = (gap**2).sum(axis=1)
        push = np.clip((2 * B / ((0.001 + d2) * (1 + A * d2**B)))[:, None] * gap, -4, 4)
        np.add.at(move, i, push)
        # As all moves of an epoch are made at once, a point goes no further than one step can.
        at = at + rate * np.clip(move, -4, 4) * 0.5
    return at


def fit(rows: DataFrame, neighbours: int = NEIGHBOURS, seed: int = SEED, most: int = MAX_POINTS) -> DataFrame:
    """The frame (id, vector, x, y) of vectors (id, vector); null and zero vectors are left out."""
    spark = rows.sparkSession
    data = rows.select("id", unit("vector").alias("vector")).where("vector IS NOT NULL")
    picked = data.orderBy(F.xxhash64("id"), "id").limit(most).orderBy("id").collect()
    x, k = np.array([r["vector"] for r in picked], dtype=np.float64), min(neighbours, len(picked) - 1)
    if k > 0:
        sent = spark.sparkContext.broadcast(x)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            points = sent.value
            for part in parts:
                for block in part["id"]:
                    mine = np.arange(block * BLOCK, min(len(points), (block + 1) * BLOCK))
                    near, far = _nearest(points, points[mine], k, mine)
                    yield pd.DataFrame({"i": mine, "near": list(near), "far": list(far)})

        found = _blocks(spark, len(x)).mapInPandas(run, "i long, near array<long>, far array<double>").orderBy("i").collect()
        at = _positions(x, np.array([r["near"] for r in found]), weights(np.array([r["far"] for r in found])), seed)
    else:
        at = np.zeros((len(picked), 2))
    kinds = dict(data.dtypes)
    placed = [(r["id"], r["vector"], float(a), float(b)) for r, (a, b) in zip(picked, at, strict=True)]
    return spark.createDataFrame(placed, f"id {kinds['id']}, vector {kinds['vector']}, x double, y double")


def place(rows: DataFrame, frame: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(id, x, y) of rows by the frame: the mean of their nearest there, by weight. A vector that the
    frame holds gets its place there; a null or zero one, or any in an empty frame, has none."""
    held = frame.limit(MAX_POINTS + 1).collect()
    if len(held) > MAX_POINTS:
        raise ValueError(f"a frame of over {MAX_POINTS} points")
    points = np.array([r["vector"] for r in held], dtype=np.float64), np.array([(r["x"], r["y"]) for r in held])
    sent, kind = rows.sparkSession.sparkContext.broadcast(points), dict(rows.dtypes)["id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, at = sent.value
        for part in parts:
            out = np.full((len(part), 2), np.nan)
            known = np.flatnonzero(part["vector"].notna()) if len(x) else []
            for k in range(0, len(known), BLOCK):
                mine = known[k : k + BLOCK]
                near, far = _nearest(x, np.stack(part["vector"].iloc[mine].to_list()).astype(np.float64), min(neighbours, len(x)))
                weight = weights(far)
                mean = (at[near] * weight[..., None]).sum(axis=1) / weight.sum(axis=1)[:, None]
                out[mine] = np.where(far[:, :1] < 1e-6, at[near[:, 0]], mean)
            yield pd.DataFrame({"id": part["id"], "x": out[:, 0], "y": out[:, 1]})

    asked = rows.select(F.col("id").cast("string").alias("id"), unit("vector").alias("vector"))
    found = asked.mapInPandas(run, "id string, x double, y double")
    return found.select(F.col("id").cast(kind).alias("id"), *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "y")])
