"""Text, semantic and hybrid search, best first."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.text import lexemes, snippet, text_score
from wakeline.functions.vectors import cosine, hybrid

from .paging import top


def query_terms(text: str) -> list[str]:
    return sorted(set(re.findall(r"\w+", text.lower())))


def by_text(docs: DataFrame, query: str, k: int, after: tuple | None = None) -> DataFrame:
    """Documents (id, body) that hold a term of the query; score is the share they hold."""
    wanted = query_terms(query)
    if not wanted:
        return docs.select("id", F.lit(0.0).alias("score"), F.lit("").alias("snippet")).limit(0)
    scored = docs.select("id", text_score(wanted, lexemes("body")).alias("score"), snippet("body").alias("snippet"))
    return top(scored.where("score > 0"), "score", "id", k, after)


def by_vector(docs: DataFrame, query: list[float], k: int, after: tuple | None = None) -> DataFrame:
    """Documents (id, vector) by similarity to a unit query vector."""
    q = F.array(*[F.lit(float(v)) for v in query])
    return top(docs.select("id", cosine("vector", q).alias("score")), "score", "id", k, after)


def by_both(docs: DataFrame, text: str, query: list[float], k: int, after: tuple | None = None) -> DataFrame:
    """Documents (id, body, vector) with an embedding, by the mean of both scores."""
    wanted = query_terms(text)
    words = text_score(wanted, lexemes("body")) if wanted else F.lit(0.0)
    q = F.array(*[F.lit(float(v)) for v in query])
    return top(docs.where("vector IS NOT NULL").select("id", hybrid(words, cosine("vector", q)).alias("score")), "score", "id", k, after)
