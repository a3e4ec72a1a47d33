"""Topics by density: clusters of a hierarchy of mutual reachability, chosen by excess of mass.

The core distance of a point is that to its `samples`-th nearest, itself included; two points
reach each other at the largest of their core distances and their own. The spanning tree of
least reach gives the hierarchy of what holds together below each distance; splits that leave
less than `least` points are points falling off, and of nested clusters those are chosen that
together keep most points over most of the scale.

The hierarchy is fitted on at most `MAX_POINTS` vectors, chosen by a hash of their ids, as it
compares all of them: each Spark task holds them and works through some rows, once for the
core distances and once for each round of the spanning tree, of which there are as many as
the logarithm of the points. Only one edge a component and round reaches the driver. Rows
beyond the sample are given to the nearest centroid by `topics.assign`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.functions.vectors import centroids, unit
from wakeline.sources.storage import checkpoint

from .topics import FLOOR, assign

MAX_POINTS = 20_000
BLOCK = 256


def _blocks(spark: SparkSession, n: int) -> DataFrame:
    """Numbers of the points' blocks, one to a row, over all cores."""
    count = -(-n // BLOCK)
    return spark.range(0, count, 1, max(1, min(count, 4 * spark.sparkContext.defaultParallelism)))


def _distances(x: np.ndarray, rows: slice) -> np.ndarray:
    found = np.sqrt(np.maximum(2 - 2 * (x[rows] @ x.T), 0))
    # A point is at its own place, whatever rounding says.
    at = np.arange(*rows.indices(len(x)))
    found[np.arange(len(at)), at] = 0
    return found


def core_distances(spark: SparkSession, x: np.ndarray, samples: int) -> np.ndarray:
    """Of unit vectors x."""
    sent, k = spark.sparkContext.broadcast(x), min(samples, len(x)) - 1

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points = sent.value
        for part in parts:
            for block in part["id"]:
                at = slice(block * BLOCK, min(len(points), (block + 1) * BLOCK))
                yield pd.DataFrame({"i": np.arange(at.start, at.stop), "d": np.partition(_distances(points, at), k, axis=1)[:, k]})

    rows = _blocks(spark, len(x)).mapInPandas(run, "i long, d double").orderBy("i").collect()
    return np.array([r["d"] for r in rows])


def spanning_tree(spark: SparkSession, x: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (reach, u, v), u < v, of the tree of least reach, equal ones by their points: in each
    round every component takes its least edge to another."""
    points, part_of = spark.sparkContext.broadcast((x, core)), np.arange(len(x))
    tree: set[tuple[float, int, int]] = set()
    while len(tree) < len(x) - 1:
        sent = spark.sparkContext.broadcast(part_of)

        def run(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            (x, core), part_of = points.value, sent.value
            for part in parts:
                for block in part["id"]:
                    at = slice(block * BLOCK, min(len(x), (block + 1) * BLOCK))
                    mine = np.arange(at.start, at.stop)
                    # Worked out alike from either end, that both see the same edge.
                    reach = np.maximum(np.maximum(_distances(x, at), core[None]), core[mine][:, None]).round(12)
                    reach[part_of[mine][:, None] == part_of[None]] = np.inf
                    low = reach.min(axis=1)
                    # Of equal edges the one of the least points: a larger mine has its least other.
                    other = np.array([np.flatnonzero(r == m)[0] for r, m in zip(reach, low, strict=True)])
                    yield pd.DataFrame({"part": part_of[mine], "w": low, "u": np.minimum(mine, other), "v": np.maximum(mine, other)})

        edges = _blocks(spark, len(x)).mapInPandas(run, "part long, w double, u long, v long")
        least = edges.groupBy("part").agg(F.min(F.struct("w", "u", "v")).alias("e")).select("e.*").distinct().collect()
        tree |= {(r["w"], r["u"], r["v"]) for r in least}
        part_of = _components(len(x), tree)
        sent.destroy()
    points.destroy()
    return sorted(tree)


class _Sets:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def _components(n: int, edges: set[tuple[float, int, int]]) -> np.ndarray:
    sets = _Sets(n)
    for _, u, v in edges:
        a, b = sets.find(u), sets.find(v)
        sets.up[max(a, b)] = min(a, b)
    return np.array([sets.find(i) for i in range(n)])


def chosen(n: int, tree: list[tuple[float, int, int]], least: int) -> np.ndarray:
    """The cluster of each of n points, -1 of outliers, from the spanning tree in order of reach."""
    # The dendrogram: node n + k joins two nodes at the k-th edge.
    sets, node = _Sets(n), list(range(n))
    join, size = [], [1] * n
    for w, u, v in tree:
        a, b = sets.find(u), sets.find(v)
        join.append((w, node[a], node[b]))
        size.append(size[node[a]] + size[node[b]])
        sets.up[b] = a
        node[a] = n + len(join) - 1

    def points(top: int) -> list[int]:
        out, stack = [], [top]
        while stack:
            i = stack.pop()
            if i < n:
                out.append(i)
            else:
                stack += join[i - n][1:]
        return out

    def apart(top: int) -> tuple[float, list[int]]:
        """What a node falls into at its reach, all at once: equal reaches have no order."""
        w, out, stack = join[top - n][0], [], [top]
        while stack:
            i = stack.pop()
            if i >= n and join[i - n][0] == w:
                stack += join[i - n][1:]
            else:
                out.append(i)
        return w, out

    scale = lambda w: 1 / max(w, 1e-12)
    parent, birth, mass, fell = [-1], [0.0], [0.0], {}
    work = [(2 * n - 2, 0)] if n > 1 else []
    while work:
        top, cluster = work.pop()
        if top < n:  # with `least` of one a single point may be a cluster: it lasts
            fell[top] = cluster
            continue
        w, parts = apart(top)
        lost = scale(w) - birth[cluster]
        large = [c for c in parts if size[c] >= least]
        gone = [c for c in parts if size[c] < least]
        mass[cluster] += lost * (size[top] if len(large) > 1 else sum(size[c] for c in gone))
        for child in gone:
            fell |= dict.fromkeys(points(child), cluster)
        for child in large:
            if len(large) == 1:
                work.append((child, cluster))
            else:
                parent.append(cluster)
                birth.append(scale(w))
                mass.append(0.0)
                work.append((child, len(parent) - 1))
    # From the leaves up: a cluster stands if it holds more than those within it together; the root never does.
    best, stands = list(mass), [False] * len(parent)
    within = [0.0] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        stands[c] = within[c] <= mass[c]
        best[c] = max(within[c], mass[c])
        within[parent[c]] += best[c]
    owner = [-1] * len(parent)
    for c in range(1, len(parent)):
        owner[c] = owner[parent[c]] if owner[parent[c]] >= 0 else (c if stands[c] else -1)
    return np.array([owner[fell[i]] if i in fell else -1 for i in range(n)])


def fit(rows: DataFrame, least: int = 10, samples: int = 5, most: int = MAX_POINTS, floor: float = FLOOR) -> tuple[DataFrame, DataFrame]:
    """Topics of vectors (id, vector): centroids (topic, centroid) and members (id, topic), topic
    null for outliers. Topics are numbered by size, largest first, ties by least member. Vectors
    that are null or zero have no topic; too few vectors are one round of outliers."""
    spark = rows.sparkSession
    data = checkpoint(rows.select("id", unit("vector").alias("vector")))
    picked = data.where("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(most).orderBy("id").collect()
    x = np.array([r["vector"] for r in picked], dtype=np.float64)
    found = chosen(len(x), spanning_tree(spark, x, core_distances(spark, x, samples)), least) if len(x) > 1 else np.full(len(x), -1)
    told = spark.createDataFrame([(r["id"], int(c)) for r, c in zip(picked, found.tolist(), strict=True)], f"id {dict(rows.dtypes)['id']}, c long")
    inside = told.where("c >= 0")
    # A row a topic.
    order = Window.orderBy(F.desc("n"), "first")
    named = inside.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("first")).select("c", (F.row_number().over(order) - 1).alias("topic"))
    members = checkpoint(told.join(F.broadcast(named), "c", "left").select("id", "topic"))
    middle = checkpoint(centroids(members.where("topic IS NOT NULL").join(data, "id"), "topic", "vector"))
    beyond = data.join(F.broadcast(members.select("id")), "id", "left_anti")
    far = beyond.where("vector IS NULL" if middle.count() else "true").select("id", F.lit(None).cast("int").alias("topic"))
    near = assign(beyond.where("vector IS NOT NULL"), middle, floor).select("id", "topic")
    return middle, members.unionByName(near).unionByName(far)
