import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from wakeline.llm import token_files
from wakeline.sources.storage import table

from .cases import empty, frame
from .test_decontaminate import words
from .test_near_copies import brute


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = docs
    for name, stage in P.STAGES[:3]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
    got = {r["doc_id"] for r in kept.collect()}
    rows = [r for r in docs.orderBy("doc_id").collect() if any(c.isalpha() for c in r["text"] or "")]
    _, root = brute({r["doc_id"]: r["text"] for r in rows})
    single = [r for r in rows if root[r["doc_id"]] == r["doc_id"]]
    windows = set()
    for r in table(spark, sf_dir, "benchmark").collect():
        w = words(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    clean = set()
    for r in single:
        w = words(r["text"])
        if not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1)):
            clean.add(r["doc_id"])
    assert got == clean


def test_run_writes_what_the_mix_takes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in P.STAGES[:4]:
        docs = P_staged(spark, stage(spark, docs, sf_dir))
    out = {(r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in P.run(spark, sf_dir).collect()}
    tokenizer = token_files.Encoder(token_files.tokenizer_path()).tokenizer
    for r in docs.collect():
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [2]
        assert (r["doc_id"], zlib.crc32(np.array(ids, dtype="<u4").tobytes()), len(ids)) in out


@pytest.mark.parametrize("kind", ["cases", "empty"])
def test_run_on_odd_tables(spark, tmp_path, kind):
    """Nulls, repeated ids, clashing columns, no documents, no benchmark items."""
    docs = frame(spark) if kind == "cases" else empty(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in out]
    assert (len(ids) > 0) == (kind == "cases") and None not in ids and 2 not in ids


def P_staged(spark, df):
    from wakeline.sources.storage import staged

    return staged(df, "test")[0]
