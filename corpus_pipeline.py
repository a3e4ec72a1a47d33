"""The corpus pipeline: documents in, token files out.

Five stages, each a whole-table transform whose output is written as Parquet and read
again as the next one's documents. All but the last keep the columns of `documents`.

1. language_id: documents whose language cannot be told go.
2. near_duplicates: of each group of near copies (similarity of five-word shingles of 0.8
   or more) the document named by the group's id, its least doc_id, stays; of equal
   doc_ids one row stays, and rows without a doc_id, which nothing can name, go.
3. decontaminate: documents that hold a benchmark window go.
4. mix: each source is brought to its target; a document taken several times has a row
   for each, and one taken in part a row with the words of the blocks taken.
5. tokens: token files, and per row of them the place, length and checksum of its ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import decontaminate, language_id, mixing, near_copies, token_files
from wakeline.llm.common import WORD, arrow_rows, new_path, table

#: A prediction below this share of the odds counts as no prediction.
LEAST_SCORE = 0.5
#: Pieces of text whose ids a worker keeps; workers go on to other stages, and these with them.
PIECES_HELD = 1 << 18
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: The stages' models are not SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(~language_id.held_out() & F.col("doc_id").isNotNull()).select("text", "lang"))
    # Equal texts are told alike, so a text's digest stands for it.
    told = language_id.predict(docs.select(F.md5("text").alias("digest"), "text"), model, key="digest")
    model.drop()
    kept = told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("digest").distinct()
    return docs.select(*COLUMNS).join(kept, F.md5("text") == F.col("digest"), "left_semi")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_copies.near_copies(docs)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi")
    # Of several rows of one doc_id the least, so that reruns agree.
    return rows.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = found.where(F.size("words") > 0).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(hit, "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(docs).where("taken > 0").select("doc_id", "every", "once")
    rows = docs.select(*COLUMNS).join(taken, "doc_id")
    words = re.compile(WORD)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                out += [tuple(r[:5])] * int(r.every)
                if len(r.once):
                    at = [m.start() for m in words.finditer(r.text)] + [len(r.text)]
                    # A whole document keeps the space before its first word too.
                    at[0] = 0
                    text = "".join(r.text[at[x["start"]] : at[x["end"]]] for x in r.once)
                    out.append((r.doc_id, text, r.lang, r.source, len(text)))
            yield pd.DataFrame(out, columns=list(COLUMNS))

    arrow_rows(spark)
    return rows.select(*COLUMNS, "every", "once").mapInPandas(cut, SCHEMA)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.round_trip(docs, cache=PIECES_HELD)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("mix", mixing_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
