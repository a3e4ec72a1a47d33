"""Removal of long repeated byte strings by sampled suffix sorting (operator 3).

A byte is removed if some 50-byte string covers it that also starts in a document with a
smaller doc_id. Only suffixes' first 50 bytes matter, so the suffix array is built to
that depth, from samples, and the rest is induced:

1. Sampling. Of the 24-byte strings inside each 50-byte window the one with the least
   hash is its anchor. Equal windows have equal anchors, wherever they are. Consecutive
   windows mostly share theirs and form a run, about one for 14 bytes.
2. Naming. Anchors are exchanged as sorted arrays of 48-bit names, each once per chunk of
   documents with its number of documents there. A name seen in one document only ends
   here: all its windows are unique. One bit comes back for each name sent.
3. Sorting. Runs under shared names are exchanged with their bytes, each distinct content
   once per chunk with the least doc_id that has it there. Names with one content need no
   more. Otherwise all suffixes (windows) of the contents are sorted by their bytes, and
   neighbours with a common prefix of 50 bytes form a class whose least doc_id is found.
4. Induction. The least doc_id of every window is carried back through its run to all the
   documents of the chunk, which mark and drop their bytes.

Texts are written once to shared storage, bucketed by chunk, so that the three passes over
them need no shuffle; only names, contents and answers move. A chunk has at most
`CHUNK_BYTES`, or one longer text. Exchanges are dealt by hash of the name into groups whose
number grows with the input. A name in more than `HOT_DOCS` documents, or with as many runs
where it repeats within texts, would make its group large, so its windows are exchanged one
by one instead, dealt by a hash of their own bytes; equal windows were merged within each
chunk before. Runs are cut after `RUN` windows, which only periodic text exceeds.

Names only select candidates. Every match is decided by comparing bytes.

Defined results: null and empty texts have no bytes; texts under 50 bytes lose nothing;
a document with a null doc_id neither causes nor suffers removal; documents of equal
doc_id do not affect each other; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, as_longs, as_texts, checkpoint, new_path, remove

LENGTH = 50
ANCHOR = 24
CHUNK_DOCS = 4096
CHUNK_BYTES = 16 << 20
GROUP_NAMES = 400_000
HOT_DOCS = 5_000
FEW_RUNS = 8
RUN = 64
SLICE = 1 << 21
PIECE = 1 << 20
NOBODY = np.iinfo(np.int64).max
MAX_BUCKETS = 100_000

# Multiplier of the rolling hash, and of its mixing step: odd 64-bit numbers.
ROLL = 0x9E3779B97F4A7C15
MIX = 0xBF58476D1CE4E5B9


def _rolled(b: np.ndarray, width: int) -> np.ndarray:
    """Mixed 48-bit hash of every `width`-byte string of b, joined from powers of two."""
    power, h, size = np.uint64(ROLL), b.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                if out is None:
                    out, done = h, size
                else:
                    n = len(out) - size
                    out = out[:n] * power + h[done : done + n]
                    done += size
            if done == width:
                break
            h = h[:-size] * power + h[size:]
            power, size = power * power, 2 * size
        out = out ^ out >> np.uint64(29)
        out *= np.uint64(MIX)
    return out >> np.uint64(16)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[: -(width - size)], values[width - size :]) if size < width else values


def runs(b: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, name) of every run. Long texts are taken in pieces, whose
    edges may cut a run in two; that changes contents, not results."""
    starts, counts, names = [], [], []
    for at in range(0, max(0, len(b) - length + 1), PIECE):
        part = b[at : at + PIECE + length - 1]
        least = _sliding_least(_rolled(part, anchor), length - anchor + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        size = np.diff(np.append(first, len(least)))
        if (size > RUN).any():
            more = -(-size // RUN)
            first = np.repeat(first - (np.cumsum(more) - more) * RUN, more) + np.arange(more.sum()) * RUN
        starts.append(first + at)
        counts.append(np.diff(np.append(first, len(least))))
        names.append(least[first])
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(names)


class Chunk:
    """Documents of one chunk, in a fixed order, end to end in one buffer."""

    def __init__(self, rows: pd.DataFrame):
        # Ids come as text, as pandas would make floats of them beside a null.
        mine = [(x is None, int(x or 0), t or "") for x, t in zip(rows["doc_id"], rows["text"], strict=True)]
        mine.sort()
        self.doc_ids = [None if none else x for none, x, _ in mine]
        texts = [t.encode("utf-8", "surrogatepass") for _, _, t in mine]
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.base = np.cumsum(self.size) - self.size
        self.bytes = b"".join(texts)
        self.buffer = np.frombuffer(self.bytes, dtype=np.uint8)
        self.order = np.array([NOBODY if x is None else x for x in self.doc_ids], dtype=np.int64)
        docs, starts, counts, names, per_doc = [], [], [], [], []
        for i, (a, n) in enumerate(zip(self.base, self.size, strict=True)):
            s, c, k = runs(self.buffer[a : a + n])
            docs.append(np.full(len(s), i, dtype=np.int32))
            starts.append(s + a)
            counts.append(c)
            names.append(k)
            per_doc.append(np.unique(k))
        self.run_doc, self.run_start = np.concatenate(docs), np.concatenate(starts)
        self.run_count, self.run_name = np.concatenate(counts), np.concatenate(names)
        self.names, name_docs = np.unique(np.concatenate(per_doc), return_counts=True)
        name_runs = np.unique(self.run_name, return_counts=True)[1]
        # What a name weighs: its documents, or its runs where texts repeat it.
        self.name_docs = np.where(name_runs > FEW_RUNS * name_docs, name_runs, name_docs)

    def entries(self, codes: np.ndarray, groups: int) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contents under shared names as (key, start, bytes), the least doc_id of
        each, and occurrences (entry, start, doc)."""
        import xxhash

        code = codes[np.searchsorted(self.names, self.run_name)]
        known: dict[bytes, int] = {}
        found: list[tuple[int, int, int]] = []
        least: list[int] = []
        at_entry, at_start, at_doc = [], [], []
        data, order = self.bytes, self.order

        def add(key: int, start: int, size: int, doc: int) -> None:
            content = data[start : start + size]
            e = known.setdefault(content, len(found))
            if e == len(found):
                found.append((key, start, size))
                least.append(int(order[doc]))
            elif order[doc] < least[e]:
                least[e] = int(order[doc])
            at_entry.append(e)
            at_start.append(start)
            at_doc.append(doc)

        which = np.flatnonzero(code)
        columns = (self.run_name[which], self.run_start[which], self.run_count[which], self.run_doc[which], code[which])
        for name, start, n, doc, c in zip(*(x.tolist() for x in columns), strict=True):
            if c == 1:
                add(name, start, n + LENGTH - 1, doc)
            else:
                for s in range(start, start + n):
                    add(xxhash.xxh64_intdigest(data[s : s + LENGTH]) >> 16, s, LENGTH, doc)
        as_long = lambda x: np.array(x, dtype=np.int64)
        return found, as_long(least), as_long(at_entry), np.stack([as_long(at_start), as_long(at_doc)])


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    import zstandard

    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(p) for p in parts], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw[: 8 * len(kinds)], dtype=np.int64)
    ends = 8 * len(kinds) + np.cumsum(sizes)
    return [np.frombuffer(raw[e - n : e], dtype=k) for e, n, k in zip(ends, sizes, kinds, strict=True)]


def _short(names: np.ndarray) -> np.ndarray:
    """Six bytes of each 48-bit name."""
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _long(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1)


NAMES = "grp long, chunk long, names binary, docs binary"
CODES = "chunk long, kind int, grp long, answer binary"
CONTENTS = "grp long, chunk long, content binary"
RESULT = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def name_answers(names: DataFrame) -> DataFrame:
    """For each name sent: 0 in one document, 1 shared, 2 shared by very many."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        sent = [_long(x) for x in rows["names"]]
        docs = [_unpacked(x, "<u2")[0] for x in rows["docs"]]
        kinds, inverse = np.unique(np.concatenate(sent), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(docs), minlength=len(kinds))
        code = ((total > 1).astype(np.uint8) + (total > HOT_DOCS))[inverse]
        cuts = np.cumsum([len(x) for x in sent])[:-1]
        return pd.DataFrame(
            {"chunk": rows["chunk"], "kind": 0, "grp": rows["grp"], "answer": [_packed(x) for x in np.split(code, cuts)]}
        )

    return names.groupBy("grp").applyInPandas(answer, CODES)


def sorted_classes(contents: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For every window of the contents the least doc_id among equal windows."""
    sizes = np.array([len(c) - LENGTH + 1 for c in contents], dtype=np.int64)
    buffer = np.frombuffer(b"".join(contents), dtype=np.uint8)
    at = np.cumsum(sizes + LENGTH - 1) - (sizes + LENGTH - 1)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.repeat(at, sizes) + within
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buffer, LENGTH)[starts])
    order = np.argsort(suffixes.view(f"V{LENGTH}").reshape(-1), kind="stable")
    ranked = suffixes[order]
    new = np.concatenate(([True], (ranked[1:] != ranked[:-1]).any(axis=1)))
    first = np.flatnonzero(new)
    smallest = np.minimum.reduceat(np.repeat(least, sizes)[order], first)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = smallest[np.cumsum(new) - 1]
    return np.split(out, np.cumsum(sizes)[:-1])


def content_answers(contents: DataFrame, sort_windows: int = 1 << 18) -> DataFrame:
    """For each content sent the least doc_id of each of its windows."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        keys: list[int] = []
        least: list[int] = []
        sent: list[list[int]] = []
        for blob in rows["content"]:
            key, size, low, raw = _unpacked(blob, "<u8", "<i4", "<i8", "u1")
            raw, at, mine = raw.tobytes(), 0, []
            for k, n, doc in zip(key.tolist(), size.tolist(), low.tolist(), strict=True):
                content = raw[at : at + n]
                at += n
                e = known.setdefault(content, len(keys))
                if e == len(keys):
                    keys.append(k)
                    least.append(doc)
                elif doc < least[e]:
                    least[e] = doc
                mine.append(e)
            sent.append(mine)
        texts, low = list(known), np.array(least, dtype=np.int64)
        order = np.argsort(np.array(keys, dtype=np.uint64), kind="stable")
        ranked = np.array(keys, dtype=np.uint64)[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        answers: list[np.ndarray] = [None] * len(texts)
        batch: list[int] = []
        windows = 0

        def close() -> None:
            for e, found in zip(batch, sorted_classes([texts[e] for e in batch], low[batch]), strict=True):
                answers[e] = found
            batch.clear()

        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            if b - a == 1:
                e = int(order[a])
                answers[e] = np.full(len(texts[e]) - LENGTH + 1, low[e], dtype=np.int64)
                continue
            batch += order[a:b].tolist()
            windows += sum(len(texts[e]) - LENGTH + 1 for e in order[a:b].tolist())
            if windows >= sort_windows:
                close()
                windows = 0
        if batch:
            close()
        return pd.DataFrame(
            {"chunk": rows["chunk"], "kind": 1, "grp": rows["grp"], "answer": [_packed(np.concatenate([answers[e] for e in mine])) for mine in sent]}
        )

    return contents.groupBy("grp").applyInPandas(answer, CODES)


def _by_group(keys: np.ndarray, groups: int) -> list[tuple[int, np.ndarray]]:
    """(group, places of its keys in order) for each group that has any."""
    of = (keys % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1]))) if len(of) else np.zeros(0, dtype=np.int64)
    return [(int(of[part[0]]), part) for part in np.split(order, first[1:]) if len(part)]


def _chunked(docs: DataFrame) -> DataFrame:
    """(chunk, doc_id, text): rows of a task in turn, bounded in bytes and documents."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, rows = TaskContext.get().partitionId() << 32, 0, 0
        for part in parts:
            of = []
            for size in pc.fill_null(pc.binary_length(part.column("text")), 0).to_pylist():
                if rows and (held + size > CHUNK_BYTES or rows >= CHUNK_DOCS):
                    chunk, held, rows = chunk + 1, 0, 0
                held, rows = held + size, rows + 1
                of.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), part.column("doc_id"), part.column("text")], ["chunk", "doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "chunk long, doc_id long, text string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the digest of what is kept."""
    spark = docs.sparkSession
    arrow_rows(spark, 1_000)
    name, path = f"wakeline_texts_{uuid.uuid4().hex}", new_path(spark, "texts")
    # Each writer fills the buckets of its own chunks, so the table is bucketed without a shuffle.
    buckets = min(MAX_BUCKETS, max(4, docs.rdd.getNumPartitions()))
    writer = _chunked(docs).write.option("compression", "zstd").option("path", path).bucketBy(buckets, "chunk").sortBy("chunk")
    try:
        writer.format("parquet").saveAsTable(name)
        return _without_repeats(spark.table(name))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def _without_repeats(texts: DataFrame) -> DataFrame:
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = as_texts(texts, "doc_id")
    groups = max(16, int(total // 14 // GROUP_NAMES))

    def send_names(rows: pd.DataFrame) -> pd.DataFrame:
        here = Chunk(rows)
        docs_ = np.minimum(here.name_docs, 65535).astype("<u2")
        out = [(g, rows["chunk"].iloc[0], _short(here.names[p]).tobytes(), _packed(docs_[p])) for g, p in _by_group(here.names, groups)]
        return pd.DataFrame(out, columns=["grp", "chunk", "names", "docs"])

    codes = checkpoint(name_answers(texts.groupBy("chunk").applyInPandas(send_names, NAMES)))

    def code_of(here: Chunk, answers: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(here.names), dtype=np.uint8)
        got = dict(zip(answers["grp"], answers["answer"], strict=True))
        for g, places in _by_group(here.names, groups):
            out[places] = _unpacked(got[g], "u1")[0]
        return out

    def send_contents(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            here = Chunk(rows)
            found, least, _, _ = here.entries(code_of(here, answers), groups)
            keys = np.array([k for k, _, _ in found], dtype=np.uint64)
            for g, places in _by_group(keys, groups):
                mine = [found[p] for p in places.tolist()]
                sizes = np.array([n for _, _, n in mine], dtype="<i4")
                content = b"".join(here.bytes[s : s + n] for _, s, n in mine)
                out.append((g, rows["chunk"].iloc[0], _packed(keys[places], sizes, least[places], content)))
        return pd.DataFrame(out, columns=["grp", "chunk", "content"])

    contents = texts.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInPandas(send_contents, CONTENTS)
    least = checkpoint(content_answers(contents))

    def finish(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=[c.split()[0] for c in RESULT.split(", ")])
        here = Chunk(rows)
        found, _, entry, (start, doc) = here.entries(code_of(here, answers[answers["kind"] == 0]), groups)
        gone = np.zeros(len(here.bytes) + 1, dtype=np.int32)
        if found:
            # Least doc_id of every window of every entry, entry after entry.
            windows = np.array([n - LENGTH + 1 for _, _, n in found], dtype=np.int64)
            at = np.cumsum(windows) - windows
            low = np.empty(windows.sum(), dtype=np.int64)
            lengths = lambda a, n: np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            got = {g: a for g, a, k in zip(answers["grp"], answers["answer"], answers["kind"], strict=True) if k == 1}
            for g, places in _by_group(np.array([k for k, _, _ in found], dtype=np.uint64), groups):
                low[lengths(at[places], windows[places])] = _unpacked(got[g], "<i8")[0]
            # Occurrences some windows at a time; a window starts once, so its mark is set, not added.
            cuts = np.flatnonzero(np.diff(np.cumsum(windows[entry]) // SLICE)) + 1
            for e, s, d in zip(np.split(entry, cuts), np.split(start, cuts), np.split(doc, cuts), strict=True):
                n = windows[e]
                hit = (low[lengths(at[e], n)] < np.repeat(here.order[d], n)) & np.repeat(here.order[d] != NOBODY, n)
                first = lengths(s, n)[hit]
                gone[first] += 1
                gone[first + LENGTH] -= 1
        covered = np.cumsum(gone[:-1], dtype=np.int32) > 0
        out = []
        for doc_id, a, size in zip(here.doc_ids, here.base.tolist(), here.size.tolist(), strict=True):
            mask = covered[a : a + size]
            spans = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if size else 0
            kept = here.buffer[a : a + size][~mask].tobytes() if spans else here.bytes[a : a + size]
            out.append((None if doc_id is None else str(doc_id), size, int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    both = codes.unionByName(least)
    return as_longs(checkpoint(texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(finish, RESULT)), "doc_id")
