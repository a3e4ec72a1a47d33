"""Near copies by similarity of word shingles, for the pipeline (stage of operator 4).

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of
0.8 or more. Operator 4 comes first: texts whose SimHash prints (of five-word shingles) differ
in two bits or fewer meet by its Golay keys. Prints of texts alike to just 0.8 differ in about
10 of 64 bits, more than keys for two errors reach, so `BANDS` of `ROWS` least hashes (MinHash)
add the candidates beyond. A pair of similarity s shares a band with chance 1 - (1 - s^7)^32:
0.9995 at 0.8, more above. Every candidate of either kind is then verified on the words of both
texts, so no link is invented, and only links missed by both are missed.

Skew. Copies with equal words are one node. Of the nodes that share a band, all are first
compared with one pivot, the node with the most company over all bands. Nodes that are then
outside the component of a pivot of theirs are compared with the others of that pivot, in
blocks of about `BLOCK` shingles a side: only links leave a block, never pairs to be tried.
Pairs within a component need no comparison, so the components are those of all pairs.

Defined results: words are split and lower-cased as in simhash.py; a text of fewer words
than a shingle is one shingle; texts without words are copies of each other; a null doc_id
never names a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.components import components

from . import simhash
from .common import arrow_rows, as_longs, as_texts, checkpoint

SHINGLE = 5
SIMILARITY = (4, 5)  # as a fraction, so that equality is exact
ROWS, BANDS = 7, 32
SEED = 42
BLOCK = 1 << 17
# Two longs each; beyond this many texts are fetched by a join of shuffled sides.
BROADCAST_IDS = 1_000_000

_RANDOM = np.random.default_rng(SEED)
FACTORS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
TERMS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def node_of(words: list[bytes]) -> int:
    """Signed 64-bit name of a sequence of words."""
    import xxhash

    n = xxhash.xxh3_64_intdigest(b" ".join(words), SEED)
    return n - (1 << 64) if n >> 63 else n


def shingles_in(words: list[bytes]) -> list[bytes]:
    """Shingles in order, repeats included."""
    return [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


def shingles_of(words: list[bytes]) -> set[bytes]:
    return set(shingles_in(words))


def alike(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


def band_keys(h: np.ndarray) -> np.ndarray:
    """Keys of the bands of a text, from the hashes of its shingles."""
    import xxhash

    least = np.full(ROWS * BANDS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(h), 512):
        np.minimum(least, (FACTORS[:, None] * h[None, at : at + 512] + TERMS[:, None]).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node (of equal words), size (shingles), SimHash print and band keys of every row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                words = words_of(text)
                shingles = shingles_in(words)
                h, n = simhash.hashes_of(shingles), len(set(shingles))
                keys = band_keys(h if n == len(h) else np.unique(h)) if words else []
                rows.append((doc_id, node_of(words), n, simhash.print_of([h]), keys))
            yield pd.DataFrame(rows, columns=["doc_id", "node", "size", "fp", "keys"])

    arrow_rows(docs.sparkSession)
    rows = as_texts(docs.select("doc_id", "text"), "doc_id")
    return as_longs(rows.mapInPandas(run, "doc_id string, node long, size int, fp long, keys array<long>"), "doc_id")


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes; a doc_id may bring texts of other nodes too."""
    ids = checkpoint(nodes.join(wanted, "node").select("node", "doc_id"))
    few = ids.count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id").select("node", "text")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of nodes that are near copies, by their texts."""
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    texts = checkpoint(_texts(wanted, nodes, docs))
    with_v = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    both = with_v.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, set[bytes] | None] = {}

        def shingles(node: int, text: str) -> set[bytes] | None:
            # A doc_id may name several texts: only the node's own text counts.
            if node not in held:
                words = words_of(text)
                if node_of(words) != node:
                    return None
                if len(held) >= 512:
                    held.clear()
                held[node] = shingles_of(words)
            return held[node]

        for part in parts:
            found = []
            for u, v, text_u, text_v in zip(part["u"], part["v"], part["text_u"], part["text_v"], strict=True):
                a, b = shingles(u, text_u), shingles(v, text_v)
                if a is not None and b is not None and alike(a, b):
                    found.append((u, v))
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    arrow_rows(docs.sparkSession)
    return checkpoint(both.select("u", "v", "text_u", "text_v").mapInPandas(run, "u long, v long").distinct())


def _close(a: str, b: str) -> str:
    """Sizes that allow the similarity."""
    return f"{SIMILARITY[1]} * least({a}, {b}) >= {SIMILARITY[0]} * greatest({a}, {b})"


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose prints operator 4 links; nodes of one print meet its least."""
    worded = nodes.where("size > 0").select("fp", "node")
    prints = checkpoint(worded.groupBy("fp").agg(F.min("node").alias("least")))
    same = worded.join(prints, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    linked = simhash.links(prints.select("fp", F.col("least").alias("node")))
    return same.where("a <> b").unionByName(linked.select(F.col("u").alias("a"), F.col("v").alias("b")))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.sort(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles_of(words)], dtype=np.uint64)).view(np.int64)


def _hashed(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, hashes) of the shingles of the wanted nodes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(n, w) for n, t in zip(part["node"], part["text"], strict=True) if node_of(w := words_of(t)) == n]
            yield pd.DataFrame([(n, shingle_hashes(w)) for n, w in found], columns=["node", "hashes"])

    arrow_rows(docs.sparkSession)
    hashed = _texts(wanted, nodes, docs).mapInPandas(run, "node long, hashes array<long>")
    # A doc_id may have the same words twice.
    return checkpoint(hashed.groupBy("node").agg(F.first("hashes").alias("hashes")))


def _linked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Near copies among a block's nodes of different components, by counting shared hashes."""
    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        sizes = np.array([len(h) for h in right["hashes"]], dtype=np.int64)
        hashes = np.concatenate(right["hashes"].tolist())
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], np.repeat(np.arange(len(right)), sizes)[order]
        node, comp, apart = (right[c].to_numpy() for c in ("node", "comp", "apart"))
        for u, own, mine in zip(left["node"], left["comp"], left["hashes"], strict=True):
            low, high = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(right))
            alike_ = SIMILARITY[1] * both >= SIMILARITY[0] * (len(mine) + sizes - both)
            found += [(u, int(v)) for v in node[alike_ & (comp != own) & (~apart | (node < u))]]
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def _links_apart(company: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (u, v) of nodes outside their pivot's component with others of the pivot;
    company: (pivot, node, size, comp, apart)."""
    held = company.join(company.where("apart").select("pivot").distinct(), "pivot")
    hashes = _hashed(held.select("node").distinct(), nodes, docs)
    full = held.groupBy("pivot").agg(
        (F.floor(F.sum(F.when(F.col("apart"), F.col("size")).otherwise(0)) / BLOCK) + 1).alias("lefts"),
        (F.floor(F.sum("size") / BLOCK) + 1).alias("rights"),
    )
    rows = held.join(full, "pivot").join(hashes, "node")
    own, every = lambda n: F.pmod(F.xxhash64("node"), n), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    key, columns = ("pivot", "left", "right"), ["pivot", "node", "comp", "apart", "hashes"]
    left = rows.where("apart").select(*columns, own("lefts").alias("left"), every("rights").alias("right"))
    # New names tell cogroup which side a column is of.
    right = rows.select(*columns, own("rights").alias("right"), every("lefts").alias("left")).toDF(*columns, "right", "left")
    return checkpoint(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_linked, "u long, v long").distinct())


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the least doc_id reachable over near copies, of every row."""
    rows = checkpoint(signatures(docs))
    nodes = rows.where("doc_id IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")
    )
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = checkpoint(keyed.join(sizes, "key"))
    weights = met.groupBy("node").agg(F.sum("n").alias("weight"))
    met = checkpoint(met.join(weights, "node").select("key", "n", "node", "size", "weight"))
    heaviest = met.groupBy("key").agg(F.max(F.struct("weight", "node", "size")).alias("pivot"))
    stars = (
        met.join(heaviest, "key")
        .where(f"node <> pivot.node AND {_close('size', 'pivot.size')}")
        .select(F.col("node").alias("a"), F.col("pivot.node").alias("b"))
    )
    edges = verified(checkpoint(_pairs(print_pairs(nodes).unionByName(stars))), nodes, docs)
    near = components(edges)
    company = met.join(heaviest, "key").select(F.col("pivot.node").alias("pivot"), "node", "size").distinct()
    placed = company.join(near, "node", "left").select("pivot", "node", "size", F.coalesce("root", "node").alias("comp"))
    main = placed.where("node = pivot").select("pivot", F.col("comp").alias("main"))
    placed = checkpoint(placed.join(main, "pivot").select("pivot", "node", "size", "comp", (F.col("comp") != F.col("main")).alias("apart")))
    if not placed.where("apart").isEmpty():
        edges = edges.unionByName(_links_apart(placed, nodes, docs))
    roots = components(edges)
    linked = nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    grouped = linked.join(least, "root").select("node", "component_id")
    return rows.join(grouped, "node", "left").select("doc_id", "component_id")
