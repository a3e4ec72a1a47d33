"""Token-ID output with frequency-ranked, byte-aligned variable-length codes (operator 5).

Documents are encoded in parallel and their ids staged; ids are counted over all of them;
documents are then range-partitioned into ascending doc_id order and written as shards of
some 8 million ids, or as `MAX_SHARDS` larger ones.
The commonest id has rank 0. A rank takes one to four bytes, low byte first; its length
less one is two bits of a control byte, four ranks to a byte, lowest bits first. Control
bytes and data bytes are kept apart, so that a 256-row table of lengths and a running sum
decode a whole block at once.

Files. `ranks/` holds (rank, id). `shards/` holds one Parquet file per shard, whose rows
are blocks in order: shard, block, start (ids of the shard before the block), doc_ids,
counts (ids of each document), control, data. Parquet is the container because Spark can
write and read it in any store. A document is never split over blocks.

Only the vocabulary's counts reach the driver, as many as the tokenizer has ids.

Defined results: a null or empty text is just the end id; documents of equal doc_id keep
a row each, ordered by a hash of their ids; a null doc_id comes first; other columns are not
carried.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, as_longs, as_texts, new_path, remove, staged

END_ID = 2
BLOCK_IDS = 1 << 18
SHARD_IDS = 1 << 23
MAX_SHARDS = 10_000
CACHE = 1_500_000

# Characters on whose classes every Unicode version agrees: a text of these is split into
# the pieces of the tokenizer's own pre-tokenizer here, any other goes to the tokenizer whole.
# So does a text that holds an added token, which the tokenizer takes out before it splits.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7E¡-¬®-ɏ–-…]")
PIECES = re.compile(
    rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
)

LENGTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.int64)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, the others in order from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class Pieces(dict):
    """Ids of pieces of text, each asked of the tokenizer's model once and remembered."""

    def __init__(self, tokenizer, raw):
        self.model, self.raw, self.letters, self.old = tokenizer.model, raw, byte_letters(), {}

    def age(self) -> None:
        """Forget what was not asked for since the last time."""
        self.old = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        if (found := self.old.get(piece)) is not None:
            self[piece] = found
            return found
        ids = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        found = self[piece] = self.raw([x.id for x in ids])
        return found


class Encoder:
    """Ids of texts as little-endian bytes, 2 or 4 per id as the vocabulary needs. Pieces
    repeat, so theirs are remembered, at most `cache` of them and those of one more text."""

    def __init__(self, path: str, plain: bool = False, cache: int = CACHE):
        """plain: added tokens' strings are ordinary text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.code, self.width = ("H", 2) if self.tokenizer.get_vocab_size() <= 1 << 16 else ("I", 4)
        self.by_pieces = "ByteLevel" in str(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if not plain]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.cache = cache
        self.known = Pieces(self.tokenizer, self.raw)

    def raw(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_pieces or OTHER.search(text) or self.added.search(text):
            return self.raw(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if 2 * len(self.known) > self.cache:
            self.known.age()
        return b"".join(map(self.known.__getitem__, PIECES.findall(text)))


def worker_encoder(path: str, cache: int = CACHE) -> Encoder:
    """The encoder of this Python worker: it and its pieces outlast a task."""
    import sys
    import types

    held = sys.modules.setdefault("_wakeline_encoder", types.ModuleType("_wakeline_encoder"))
    if getattr(held, "made_for", None) != (path, cache):
        held.made_for, held.encoder = (path, cache), Encoder(path, cache=cache)
    return held.encoder


def encoded(docs: DataFrame, path: str, end_id: int = END_ID, cache: int = CACHE) -> DataFrame:
    """doc_id and its ids, end id included, as little-endian bytes of 2 or 4 per id."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        one = worker_encoder(path, cache)
        end = one.raw([end_id])
        for part in parts:
            ids = [one.encode(t) + end for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "width": one.width, "ids": ids})

    arrow_rows(docs.sparkSession)
    rows = as_texts(docs.select("doc_id", "text"), "doc_id")
    return as_longs(rows.mapInPandas(run, "doc_id string, width int, ids binary"), "doc_id")


def count_ids(rows: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, dtype=np.int64)
        for part in parts:
            for width, rows_ in part.groupby("width"):
                some = np.bincount(np.frombuffer(b"".join(rows_["ids"]), dtype=f"<u{width}"), minlength=len(total))
                some[: len(total)] += total
                total = some
        found = np.nonzero(total)[0]
        yield pd.DataFrame({"id": found, "n": total[found]})

    return rows.select("width", "ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    v = ranks.astype("<u4")
    lengths = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    codes[: len(v)] = lengths - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Ranks of a block of n, by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.cumsum(lengths) - lengths
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.nonzero(lengths > k)[0]
        if len(more):
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


BLOCKS = "shard int, block int, start long, doc_ids array<long>, counts array<int>, control binary, data binary"


def write(
    docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, shard_ids: int = SHARD_IDS, cache: int = CACHE
) -> None:
    """Write docs (doc_id, text) as token files under `out`."""
    spark = docs.sparkSession
    rows, temporary = staged(encoded(docs, path or tokenizer_path(), end_id, cache), "token-ids")
    counted = count_ids(rows).orderBy(F.desc("n"), "id").collect()
    ranks = np.zeros(1 + max((r["id"] for r in counted), default=0), dtype=np.uint32)
    ranks[[r["id"] for r in counted]] = np.arange(len(counted), dtype=np.uint32)
    spark.createDataFrame([(k, r["id"], r["n"]) for k, r in enumerate(counted)], "rank int, id int, n long").coalesce(1).write.parquet(f"{out}/ranks")
    shards = max(1, min(MAX_SHARDS, -(-sum(r["n"] for r in counted) // shard_ids)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, block, start, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []
        doc_ids: list = []

        def close() -> pd.DataFrame:
            ids = np.concatenate(held)
            control, data = pack(ids)
            counts = [len(x) for x in held]
            return pd.DataFrame([(shard, block, start, list(doc_ids), counts, control, data)], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        for part in parts:
            for doc_id, width, ids in zip(part["doc_id"], part["width"], part["ids"], strict=True):
                held.append(ranks[np.frombuffer(ids, dtype=f"<u{width}")])
                doc_ids.append(None if doc_id is None else int(doc_id))
                size += len(held[-1])
                if size >= block_ids:
                    yield close()
                    block, start, size = block + 1, start + size, 0
                    held.clear()
                    doc_ids.clear()
        if held:
            yield close()

    arrow_rows(spark)
    # Rows of one doc_id, or without one, may fill several shards: they are split by their ids.
    tied = rows.withColumn("tie", F.xxhash64("ids"))
    ordered = tied.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").drop("tie")
    as_texts(ordered, "doc_id").mapInPandas(run, BLOCKS).write.option("compression", "zstd").parquet(f"{out}/shards")
    remove(spark, temporary)


def read(spark: SparkSession, out: str) -> DataFrame:
    """Documents from token files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/shards")
    ids = np.array([r["id"] for r in spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()], dtype="<u4")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for b in part.itertuples(index=False):
                counts = np.asarray(b.counts, dtype=np.int64)
                ends = np.cumsum(counts)
                found = ids[unpack(b.control, b.data, int(ends[-1]))].tobytes()
                yield pd.DataFrame(
                    {
                        "shard": b.shard,
                        "doc_id": list(b.doc_ids),
                        "at": b.start + ends - counts,
                        "n_tokens": counts,
                        "ids_crc32": [zlib.crc32(found[4 * (e - n) : 4 * e]) for e, n in zip(ends, counts, strict=True)],
                    }
                )

    totals = blocks.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # One row per shard.
    before = totals.selectExpr("shard", "sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    arrow_rows(spark)
    texts = blocks.withColumn("doc_ids", F.col("doc_ids").cast("array<string>"))
    rows = as_longs(texts.mapInPandas(run, "shard int, doc_id string, at long, n_tokens long, ids_crc32 long"), "doc_id")
    return rows.join(before, "shard").select("doc_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, out: str | None = None, cache: int = CACHE) -> DataFrame:
    spark = docs.sparkSession
    out = out or new_path(spark, "token-files")
    write(docs, out, cache=cache)
    return read(spark, out)
