"""Ids over 2**53 beside a null, as hashes are, must come through every operator unchanged."""

import pytest

from wakeline.llm import near_copies, simhash, substring_dedup, token_files

IDS = [2**53 + 1, None, 2**53 + 3, -(2**63), 2**63 - 1]


@pytest.mark.parametrize("run", [simhash.near_duplicates, token_files.round_trip, substring_dedup.remove_repeats, near_copies.near_copies])
def test_ids_beside_a_null(spark, run):
    rows = [(i, f"{k} words of an own text, of the row {k * 77} alone and of no other {'abcdefgh'[k] * 40}") for k, i in enumerate(IDS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(map(str, (r["doc_id"] for r in run(docs).collect()))) == sorted(map(str, IDS))


def test_pipeline_stages_lose_no_document_beside_a_null(spark, sf_dir):
    import corpus_pipeline

    words = "wake line of some quiet river where boats and birds pass under old stone bridges every early morning".split()
    text = lambda k: " ".join(words[(k * k + j * (k + 3)) % len(words)] + str((j * k) % 7) for j in range(60))
    rows = [(None if k == 7 else 2**53 + 1 + 2 * k, text(k), "en", "a", 1) for k in range(21)]
    docs = spark.createDataFrame(rows, corpus_pipeline.SCHEMA).coalesce(1)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir)
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows if r[0] is not None}
    clean = corpus_pipeline.decontamination_stage(spark, docs, sf_dir)
    assert clean.count() == len(rows)
