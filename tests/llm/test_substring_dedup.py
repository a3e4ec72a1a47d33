import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wakeline.llm import substring_dedup as D

from .cases import empty, frame, rows


def brute(docs, length=50):
    out = {}
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def documents(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (9, 14, 30, 60)] + ["z" * 130, "ab" * 70]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 25))))
        docs.append((i * 3, rng.choice(["", " ", "x"]).join(parts)))
    docs += [(1000 + i, docs[i][1]) for i in range(15)] + [(2000 + i, docs[i][1][3:]) for i in range(15)]
    return docs


@pytest.mark.parametrize("hot, chunk", [(10_000, 4096), (2, 10)])
def test_against_brute_force(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(D, "HOT_DOCS", hot)
    monkeypatch.setattr(D, "CHUNK_DOCS", chunk)
    docs = documents(hot)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r[1:]) for r in D.remove_repeats(df).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("size", [1, 3000])
def test_chunks_are_bounded_in_bytes(spark, monkeypatch, size):
    monkeypatch.setattr(D, "CHUNK_BYTES", size)
    docs = documents(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sizes = D._chunked(df).selectExpr("chunk", "octet_length(text) AS n").groupBy("chunk").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()
    assert all(r["n"] <= size or r["docs"] == 1 for r in sizes) and len(sizes) > 3
    assert {r[0]: tuple(r[1:]) for r in D.remove_repeats(df).collect()} == brute(docs)


def test_texts_larger_than_a_chunk(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefgh ", k=D.CHUNK_BYTES + 1000))
    docs = [(1, long), (2, "-" * 3_000_000), (3, long[:-1] + "!"), (4, "x" + "-" * 2_000_000), (5, long[500:900])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in D.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(1)).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (len(long) - 1, 1), 4: (2_000_000, 1), 5: (400, 1)}


def test_rulers_do_not_make_a_group_large(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT_DOCS", 20)
    docs = [(i, "".join(f"{'-' * 40} row {i % 5} {k}\n" for k in range(40))) for i in range(12)]
    assert {r[0]: tuple(r[1:]) for r in D.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == brute(docs)


def test_pieces_of_long_texts_agree(monkeypatch):
    import numpy as np

    b = np.frombuffer(b"".join(f"{i * i % 9973} ".encode() for i in range(4000)), dtype=np.uint8)
    whole = D.runs(b)
    monkeypatch.setattr(D, "PIECE", 1000)
    cut = D.runs(b)
    expand = lambda r: np.repeat(r[2], r[1])
    assert (expand(whole) == expand(cut)).all() and whole[1].sum() == cut[1].sum() == len(b) - 49


def test_edges(spark):
    out = D.remove_repeats(frame(spark))
    assert out.count() == len(rows())
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == got[2]["n_bytes"]
    assert got[None]["n_removed"] == 0 and got[4]["n_bytes"] == 0
    # Equal doc_ids do not affect each other.
    assert got[9]["n_removed"] == 0
    assert D.remove_repeats(empty(spark)).count() == 0
