import random
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from wakeline.llm import token_files as T

from .cases import empty, frame, rows


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70000), st.integers(0, 2**32 - 1)), max_size=200))
def test_pack_round_trip(values):
    ranks = np.array(values, dtype=np.uint32)
    control, data = T.pack(ranks)
    assert (T.unpack(control, data, len(ranks)) == ranks).all()
    assert len(control) == -(-len(ranks) // 4)


def whole_ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids if text else []


def test_pieces_are_the_tokenizers_own():
    import regex

    own = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    usual = [chr(i) for i in range(0x3000) if not T.OTHER.search(chr(i))]
    rng = random.Random(1)
    text = "".join(rng.choice(usual) if rng.random() < 0.6 else rng.choice(" \n'sabc1\t") for _ in range(50_000))
    assert own.findall(text) == T.PIECES.findall(text)
    one = T.Encoder(T.tokenizer_path())
    assert one.encode(text) == one.raw(whole_ids(one.tokenizer, text))


@pytest.mark.parametrize("block, shard", [(T.BLOCK_IDS, T.SHARD_IDS), (50, 500)])
def test_round_trip_against_whole_texts(spark, block, shard):
    docs = [r for r in rows() if r[0] is not None]
    docs = list({r[0]: r for r in docs}.values())
    df = spark.createDataFrame([(r[0], r[1]) for r in docs], "doc_id long, text string").repartition(3)
    out = T.new_path(spark, "tokens")
    T.write(df, out, block_ids=block, shard_ids=shard)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in T.read(spark, out).collect()}
    tokenizer, start = T.Encoder(T.tokenizer_path()).tokenizer, 0
    for r in sorted(docs):
        ids = whole_ids(tokenizer, r[1]) + [2]
        assert got[r[0]] == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_added_tokens_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(T.tokenizer_path())
    one = T.Encoder(T.tokenizer_path())
    added = [t.content for t in fresh.get_added_tokens_decoder().values()]
    assert added
    for a in added:
        texts = [a, f"some words{a}more words", f"x {a} {a}{a}\n", a[:-1], f"no token here, {a[1:]}", "plain words"]
        for text in texts:
            assert one.encode(text) == one.raw(fresh.encode(text, add_special_tokens=False).ids)


def test_repeated_and_null_ids_fill_several_shards(spark):
    docs = [(i if i is None or i % 7 else 7, f"text {k} of this id {k * k}") for k in range(300) for i in (None, 7, k)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = T.new_path(spark, "tokens")
    T.write(df, out, block_ids=100, shard_ids=1000)
    assert spark.read.parquet(f"{out}/shards").select("shard").distinct().count() > 4
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in T.read(spark, out).collect()), key=lambda r: r[1])
    one, want = T.Encoder(T.tokenizer_path()), []
    for i, text in docs:
        ids = whole_ids(one.tokenizer, text) + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    key = lambda r: (r[0] is not None, *(x or 0 for x in r))
    assert sorted(((i, n, c) for i, _, n, c in got), key=key) == sorted(want, key=key)
    assert [i for i, *_ in got] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i or 0))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0


def test_edges(spark):
    assert T.round_trip(frame(spark)).count() == len(rows())
    assert T.round_trip(empty(spark)).count() == 0
