"""Cross-tokenizer alignment of token ids (operator 11).

Both tokenizers' tokens of space+text are laid over its bytes. Byte offsets where tokens of
both end cut them into groups; tokens that share a group are linked; a pair of ids counts the
documents that hold it linked.

Units. Neither tokenizer joins a character to a space after it, so texts fall apart at such
spaces into units of which each is tokenized and aligned on its own (`splits_safely` asks the
vocabulary; else a text is one unit). Tasks keep each distinct unit of a chunk of texts once.

Alignment. How tokens fall into groups depends only on their lengths, so every distinct pair
of length lists is aligned once, with relational steps alone (`alignments`): tokens are
exploded with their places, a window sums their lengths to ends, an equi-join on list and
end finds the cuts, a running count of cuts is the group, and a join on list and group gives
the links. Chunks get the places of their lists by a join and read their ids through them.

Counts. A chunk counts each pair once a document and gives one row per pair; these are summed
over the corpus, compared per A id, and joined back to the chunks that hold the pair.

Skew. A list or pair is at most once in a chunk, so no join key exceeds the number of chunks;
a chunk holds `CHUNK_BYTES` of texts or one longer text.

Defined results: null and empty texts, and texts that a tokenizer does not give back byte for
byte, have no tokens, zeros and the empty string; special tokens' strings are plain text;
repeated rows are documents of their own; a null doc_id stays null; other columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows
from .common import staged as written
from .token_files import Encoder, byte_letters

CHUNK_BYTES = 8 << 20
SPACE = "▁"
#: Before each space that follows neither white space nor the piece vocabulary's own space; one
#: that ends the text is no unit of its own, as the piece model would put nothing for it.
SPLIT = re.compile(rf"(?<=[^\s{SPACE}])(?= .)", re.DOTALL)
HEX = re.compile(r"<0x([0-9A-F]{2})>")
#: Pieces that a worker remembers: it keeps its tokenizers, so these add to all that later tasks take.
PIECES_HELD = 1 << 18
#: Units encoded as one text at most, and units tokenized at a time.
JOINED = 1 << 6
UNITS = 1 << 12
#: Units written as text at a time.
UNITS_WRITTEN = 1 << 15
#: What may follow a token in a unit's text.
MARKS = (",", "|", ";", "")
COMMA, BAR, SEMICOLON, LAST = range(4)
#: Pairs of document and unit looked at together.
SLICE = 1 << 20


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Ids and bytes of a unit by both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = Encoder(path_a, plain=True, cache=PIECES_HELD), SentencePieceProcessor(model_file=path_b)
        letters = {letter: byte for byte, letter in byte_letters().items()}
        vocabulary = self.a.tokenizer.get_vocab()
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[ord(c)] for c in piece) if all(ord(c) in letters for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := HEX.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        self.long_a, self.long_b = (np.array([len(x) for x in of]) for of in (self.bytes_a, self.bytes_b))
        self.splits = splits_safely(self.b, pieces, self.bytes_b)

    def units(self, text: str) -> list[str]:
        return SPLIT.split(f" {text}") if self.splits else [f" {text}"]

    def encode(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of both, and whether both give the unit's bytes back; units start with a space."""
        n_a, n_b, ids_a, ids_b, same = self.flat(units)
        return np.split(ids_a, np.cumsum(n_a)[:-1]), np.split(ids_b, np.cumsum(n_b)[:-1]), same

    def flat(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """The same as numbers of ids of each unit and all ids end to end: n_a, n_b, ids_a, ids_b, same."""
        raw = [u.encode() for u in units]
        ends, whole = np.cumsum([len(x) for x in raw]), b"".join(raw)
        if joined := self.splits and self.joined(units, ends, whole):
            return joined
        a, b = list(map(self.a.encode, units)), self.b.encode([u[1:] for u in units], num_threads=1)
        n_a = np.fromiter(map(len, a), dtype=np.int64, count=len(a)) // self.a.width
        n_b = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
        ids_a = np.frombuffer(b"".join(a), dtype=f"<u{self.a.width}").astype(np.int32)
        ids_b = np.fromiter(chain.from_iterable(b), dtype=np.int32, count=n_b.sum())
        told = [list(map(of.__getitem__, ids.tolist())) for of, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))]
        cuts = [np.cumsum([0, *map(len, x)])[np.cumsum(n)] for x, n in zip(told, (n_a, n_b), strict=True)]
        if all(b"".join(x) == whole and np.array_equal(cut, ends) for x, cut in zip(told, cuts, strict=True)):
            return n_a, n_b, ids_a, ids_b, np.ones(len(units), dtype=bool)
        side = lambda x, n: [b"".join(x[e - k : e]) for e, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
        sides = (side(x, n) for x, n in zip(told, (n_a, n_b), strict=True))
        return n_a, n_b, ids_a, ids_b, np.array([x == y == z for x, y, z in zip(raw, *sides, strict=True)], dtype=bool)

    def joined(self, units: list[str], ends: np.ndarray, whole: bytes) -> tuple[np.ndarray, ...] | None:
        """As `flat`, but many units are encoded as one text, and its ids are cut where units end;
        None unless all are given back byte for byte and a token ends with every unit."""
        texts, start = [], 0
        for stop, unit in enumerate(units, 1):
            # A unit that ends in white space might go on in the one after it, so it ends a text.
            if stop - start == JOINED or stop == len(units) or unit[-1] == SPACE or unit[-1].isspace():
                texts.append("".join(units[start:stop]))
                start = stop
        told = [x.ids for x in self.a.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)
        numbers, sides = [], []
        for of, long, side in zip((self.bytes_a, self.bytes_b), (self.long_a, self.long_b), told, strict=True):
            flat = list(chain.from_iterable(side))
            ids = np.array(flat, dtype=np.int32)
            cuts = np.cumsum(long[ids])
            at = np.searchsorted(cuts, ends)
            if b"".join(map(of.__getitem__, flat)) != whole or not np.array_equal(cuts[at], ends):
                return None
            numbers.append(np.diff(at, prepend=-1))
            sides.append(ids)
        return *numbers, *sides, np.ones(len(units), dtype=bool)


def splits_safely(model, pieces: list[str], bytes_of: list[bytes]) -> bool:
    """Whether no piece goes on over a space and the model changes no character before it splits."""
    probe = "x ﬁ ½ 　 é  ① y"
    told = b"".join(bytes_of[i] for i in model.encode(probe))
    return not any(SPACE in p.lstrip(SPACE) for p in pieces) and told == f" {probe}".encode()


def worker_tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """Those of this Python worker: they outlast a task."""
    import sys
    import types

    held = sys.modules.setdefault("_wakeline_tokenizers", types.ModuleType("_wakeline_tokenizers"))
    if getattr(held, "paths", None) != (path_a, path_b):
        held.paths, held.both = (path_a, path_b), Tokenizers(path_a, path_b)
    return held.both


def _packed(values, kind: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(values, dtype=kind).tobytes(), 1)


def _array(packed, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), dtype=kind)


# A chunk: its documents' units (a number of units each, then unit numbers), the units' tokens
# and the numbers of their length lists, and these lists.
CHUNK = (
    "chunk long, doc_ids array<long>, sizes binary, units binary, n_a binary, n_b binary, ids_a binary, ids_b binary, sound binary, "
    "lists binary, lengths array<struct<a:array<int>,b:array<int>>>"
)
CHUNK_TYPE = pa.schema(
    [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
    + [(c, pa.binary()) for c in ("sizes", "units", "n_a", "n_b", "ids_a", "ids_b", "sound", "lists")]
    + [("lengths", pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))]
)


def _chunk(number: int, doc_ids: list, sizes: list[int], order: array, units: list[str], both: Tokenizers) -> pa.RecordBatch:
    # Units some at a time, as libraries' results take many times the room of ids.
    told = [both.flat(units[k : k + UNITS]) for k in range(0, max(1, len(units)), UNITS)]
    n_a, n_b, ids_a, ids_b, sound = (np.concatenate(x) for x in zip(*told, strict=True))
    len_a, len_b = both.long_a[ids_a].astype("<i4").tobytes(), both.long_b[ids_b].astype("<i4").tobytes()
    known: dict[tuple[bytes, bytes], int] = {}
    lists, at_a, at_b = [], 0, 0
    for x, y in zip(n_a.tolist(), n_b.tolist(), strict=True):
        key = (len_a[at_a : at_a + 4 * x], len_b[at_b : at_b + 4 * y])
        at_a, at_b = at_a + 4 * x, at_b + 4 * y
        lists.append(known.setdefault(key, len(known)))
    lengths = [{"a": np.frombuffer(x, "<i4"), "b": np.frombuffer(y, "<i4")} for x, y in known]
    row = [number, doc_ids, _packed(sizes, "<i4"), _packed(order, "<i4"), _packed(n_a, "<i4"), _packed(n_b, "<i4"), _packed(ids_a, "<i4"),
           _packed(ids_b, "<i4"), _packed(sound, "u1"), _packed(lists, "<i4"), lengths]
    return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, CHUNK_TYPE, strict=True)], schema=CHUNK_TYPE)


def chunks(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents as chunks of units and tokens; every chunk has a number of its own."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        both, number = worker_tokenizers(path_a, path_b), TaskContext.get().partitionId() << 32
        doc_ids, sizes, order, known, held = [], [], array("i"), {}, 0
        for part in parts:
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                units = both.units(text) if text else []
                doc_ids.append(doc_id)
                sizes.append(len(units))
                order.extend([known.setdefault(u, len(known)) for u in units])
                held += len(text or "")
                if held >= chunk_bytes:
                    yield _chunk(number, doc_ids, sizes, order, list(known), both)
                    number += 1
                    doc_ids, sizes, order, known, held = [], [], array("i"), {}, 0
        if doc_ids:
            yield _chunk(number, doc_ids, sizes, order, list(known), both)

    return docs.select("doc_id", "text").mapInArrow(run, CHUNK)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Written and read back, and what was shuffled to write it is dropped at once: it is not read again."""
    spark, name_of = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name_of, "false")
    spark.conf.set(name_of, "true")
    try:
        return written(df, name)
    finally:
        spark.conf.set(name_of, before)


def alignments(lists: DataFrame) -> DataFrame:
    """Groups and links of pairs of length lists (list, a, b): per list the group of every
    token of either side, in order, and the places of the linked tokens."""
    each = Window.partitionBy("list").orderBy("pos")
    before = each.rowsBetween(Window.unboundedPreceding, -1)

    def tokens(side: str) -> DataFrame:
        return lists.select("list", F.posexplode(side).alias("pos", "len")).withColumn("end", F.sum("len").over(each)).drop("len")

    a, b = tokens("a"), tokens("b")
    cuts = a.join(b.select("list", "end"), ["list", "end"]).select("list", "end", F.lit(1).alias("cut"))

    def grouped(side: DataFrame) -> DataFrame:
        known = side.join(cuts, ["list", "end"], "left")
        return known.select("list", "pos", F.coalesce(F.sum("cut").over(before), F.lit(0)).cast("int").alias("group"))

    def in_order(side: DataFrame, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct("pos", "group")))
        return side.groupBy("list").agg(F.transform(pairs, lambda x: x["group"]).alias(name))

    a, b = grouped(a), grouped(b)
    met = a.withColumnRenamed("pos", "i").join(b.withColumnRenamed("pos", "j"), ["list", "group"])
    links = met.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("met"))
    links = links.select("list", F.transform("met", lambda x: x["i"]).alias("link_a"), F.transform("met", lambda x: x["j"]).alias("link_b"))
    return in_order(a, "group_a").join(in_order(b, "group_b"), "list").join(links, "list")


class Chunk:
    """Units, links and documents of one chunk, with the alignments of its length lists."""

    def __init__(self, row: pa.Table, answers: pa.Table):
        one = {c: row.column(c)[0] for c in row.column_names}
        read = lambda c, kind="<i4": _array(one[c].as_py(), kind).astype(np.int64)
        self.doc_ids = one["doc_ids"].values
        self.sizes, self.units, self.n_a, self.n_b = read("sizes"), read("units"), read("n_a"), read("n_b")
        self.ids_a, self.ids_b, self.sound, self.lists = read("ids_a"), read("ids_b"), read("sound", "u1") > 0, read("lists")
        order = np.argsort(answers.column("number").to_numpy())
        self.group_a, self.group_b, link_a, link_b = (_Lists(answers.column(c), order) for c in ("group_a", "group_b", "link_a", "link_b"))
        self.first_a, self.first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        self.n_links = link_a.sizes[self.lists]
        self.pairs = self.ids_a[link_a.of(self.lists, self.first_a)] << 32 | self.ids_b[link_b.of(self.lists, self.first_b)]
        self.doc_of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        bad = np.zeros(len(self.sizes), dtype=bool)
        bad[self.doc_of[~self.sound[self.units]]] = True
        # Documents that are not given back byte for byte have no tokens.
        self.live = ~bad[self.doc_of]
        self.bad = bad

    def held(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct (document, unit), some whole documents at a time."""
        docs, units = self.doc_of[self.live], self.units[self.live]
        cuts = np.searchsorted(docs, docs[SLICE::SLICE], "left") if len(docs) > SLICE else []
        for d, u in zip(np.split(docs, cuts), np.split(units, cuts), strict=True):
            if len(d):
                keys = np.unique(d * len(self.n_a) + u)
                yield keys // len(self.n_a), keys % len(self.n_a)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the chunk, and how many of its documents hold each."""
        distinct, number = np.unique(self.pairs, return_inverse=True)
        first, total = np.cumsum(self.n_links) - self.n_links, np.zeros(len(distinct), dtype=np.int64)
        for docs, units in self.held():
            n = self.n_links[units]
            pair = number[_ranges(first[units], n)]
            once = np.unique(np.repeat(docs, n) * len(distinct) + pair)
            total += np.bincount(once % len(distinct), minlength=len(distinct))
        return distinct[total > 0], total[total > 0]

    def texts(self) -> list[str]:
        """Every unit's groups as text."""
        # Once per list: the order of its tokens by group and side, and the mark after each.
        size_a, size_b = self.group_a.sizes, self.group_b.sizes
        n = size_a + size_b
        of_list = np.concatenate((np.repeat(np.arange(len(n)), size_a), np.repeat(np.arange(len(n)), size_b)))
        group = np.concatenate((self.group_a.flat, self.group_b.flat))
        # A token's place on its side; places of B are below zero.
        place = np.concatenate((_ranges(np.zeros_like(size_a), size_a), -1 - _ranges(np.zeros_like(size_b), size_b)))
        order = np.lexsort((place < 0, group, of_list))
        of_list, group, place = of_list[order], group[order], place[order]
        mark = np.full(len(order), LAST)
        if len(order):
            same = of_list[1:] == of_list[:-1]
            within = np.where((place[1:] < 0) == (place[:-1] < 0), COMMA, BAR)
            mark[:-1] = np.where(same, np.where(group[1:] == group[:-1], within, SEMICOLON), LAST)
        first, out = np.cumsum(n) - n, []
        # Units some at a time, as strings take many times the room of ids.
        for at in range(0, len(self.lists), UNITS_WRITTEN):
            lists = self.lists[at : at + UNITS_WRITTEN]
            took = _ranges(first[lists], n[lists])
            put, side_b = place[took], place[took] < 0
            start_a, start_b = (np.repeat(x[at : at + UNITS_WRITTEN], n[lists]) for x in (self.first_a, self.first_b))
            ids = np.empty(len(took), dtype=np.int64)
            ids[~side_b] = self.ids_a[(start_a + put)[~side_b]]
            ids[side_b] = self.ids_b[(start_b - 1 - put)[side_b]]
            distinct, code = np.unique(ids * len(MARKS) + mark[took], return_inverse=True)
            words = [f"{x // len(MARKS)}{MARKS[x % len(MARKS)]}" for x in distinct.tolist()]
            told, ends = list(map(words.__getitem__, code.tolist())), np.cumsum(n[lists])
            out += ["".join(told[x:y]) for x, y in zip((ends - n[lists]).tolist(), ends.tolist(), strict=True)]
        return out


class _Lists:
    """A column of lists, by number, as one flat array."""

    def __init__(self, column: pa.ChunkedArray, order: np.ndarray):
        one = column.take(pa.array(order)).combine_chunks()
        one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
        self.flat = one.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes = np.asarray(one.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def at(self, k: int) -> np.ndarray:
        return self.flat[self.first[k] : self.first[k] + self.sizes[k]]

    def of(self, numbers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The lists of these numbers end to end, each moved by its offset."""
        n = self.sizes[numbers]
        return self.flat[_ranges(self.first[numbers], n)] + np.repeat(offsets, n)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


ANSWERS = ["number", "group_a", "group_b", "link_a", "link_b"]
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _count(row: pa.Table, answers: pa.Table) -> pa.Table:
    pairs, n = Chunk(row, answers).counts()
    return pa.table({"chunk": pa.array([row.column("chunk")[0].as_py()] * len(pairs), pa.int64()), "pair": pairs, "n": n})


def _finish(row: pa.Table, rest: pa.Table) -> pa.Table:
    import pyarrow.compute as pc

    here = Chunk(row, rest.filter(pc.is_valid(rest.column("number"))))
    known = rest.filter(pc.is_valid(rest.column("pair"))).sort_by("pair")
    pairs, total, best = (known.column(c).to_numpy() for c in ("pair", "total", "best"))
    place = np.minimum(np.searchsorted(pairs, here.pairs), max(0, len(pairs) - 1))
    # Pairs that only documents without tokens hold are not counted, nor read.
    of_pair = lambda values: np.where(pairs[place] == here.pairs, values[place], 0) if len(pairs) else np.zeros(len(here.pairs), np.int64)
    edges = np.concatenate(([0], np.cumsum(here.n_links)))
    sums = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[edges])
    per_unit = [here.n_a, here.n_b, np.array([int(here.group_a.at(k)[-1]) + 1 for k in range(len(here.group_a.sizes))], dtype=np.int64)[here.lists] if len(here.lists) else here.lists,
                here.n_links, sums(of_pair(best)), sums(of_pair(total))]
    ends = np.concatenate(([0], np.cumsum(here.sizes)))
    per_doc = [np.diff(np.concatenate(([0], np.cumsum(np.where(here.live, x[here.units], 0))))[ends]) for x in per_unit]
    texts, units, groups = here.texts(), here.units, []
    for k, (start, stop) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        groups.append("" if here.bad[k] else ";".join(map(texts.__getitem__, units[start:stop].tolist())))
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    return pa.table([here.doc_ids.cast(pa.int64()), *per_doc, pa.array(groups, pa.string())], names=names)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: tokens of either side, groups, links, links that are their A id's commonest,
    the sum of the links' counts, and the groups as text, `a1,a2|b1;a3|b2,b3`."""
    spark = docs.sparkSession
    arrow_rows(spark)
    kept, _ = staged(chunks(docs, path_a or paths()[0], path_b or paths()[1], chunk_bytes), "token-chunks")
    answers = _answers(spark, kept)
    spread = Window.partitionBy("a")
    counted, _ = staged(kept.drop("lengths").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_count, "chunk long, pair long, n long"), "pair-counts")
    totals = counted.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("a", F.shiftright("pair", 32))
    totals = totals.select("pair", "total", (F.col("total") == F.max("total").over(spread)).cast("long").alias("best"))
    rest = answers.unionByName(counted.drop("n").join(totals, "pair"), allowMissingColumns=True)
    return kept.drop("lengths").groupBy("chunk").cogroup(rest.groupBy("chunk")).applyInArrow(_finish, ALIGNED)


def _answers(spark: SparkSession, kept: DataFrame) -> DataFrame:
    """(chunk, number, groups and links) of every length list of every chunk."""
    held = kept.select("chunk", F.posexplode("lengths").alias("number", "of")).select("chunk", "number", "of.a", "of.b")
    lists, _ = staged(held.groupBy("a", "b").agg(F.lit(1)).select(F.monotonically_increasing_id().alias("list"), "a", "b"), "length-lists")
    told = lists.join(alignments(lists), "list").drop("list")
    return staged(held.join(told, ["a", "b"]).select("chunk", *ANSWERS), "alignments")[0]


def digest(aligned: DataFrame) -> DataFrame:
    hashed = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return aligned.withColumn("groups_sha256", hashed).drop("groups")
