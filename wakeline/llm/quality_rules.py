"""Quality rules as a bitmask ledger (operator 1).

Every rule is evaluated once per document. Its measurements and one failure bit per
rule are stored; a policy is a named, versioned mask over those bits, so policies can
be applied, compared and ablated later without reading any text again.

Only built-in column functions are used. Nothing is exploded or shuffled: repeated
five-word windows are found inside the row, by sorting 64-bit window hashes.

Defined results: null and empty texts have no words, all counts 0, and fail
`few_words`. Repeated rows are judged one by one. Extra columns of the input are not
carried, so clashing names cannot matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


# Bits are positions in this list and never change meaning; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("exclamations", "100 * n_bangs > 50 * n_words"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask(self.rules)


POLICIES = {
    ("base", 1): Policy("base", 1, BASE),
    ("standard", 1): Policy("standard", 1, tuple(r.name for r in RULES)),
}
PRODUCTION = POLICIES["standard", 1]


def mask(names: tuple[str, ...]) -> int:
    known = [r.name for r in RULES]
    return sum(1 << known.index(n) for n in names)


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Measurements of every document, one row each."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(
        F.col(key),
        body.alias("_t"),
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_w"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    hashed = words.select(
        key,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"CASE WHEN size(_w) >= {WINDOW} THEN transform(sequence(0, size(_w) - {WINDOW}), "
            f"i -> xxhash64({', '.join(f'_w[i + {k}]' for k in range(WINDOW))})) ELSE array() END"
        ).alias("_h"),
    )
    # Sorting is left to the few documents in which some window hash comes twice.
    ranked = hashed.withColumn(
        "_s",
        F.expr(
            "CASE WHEN size(array_distinct(_h)) < size(_h) "
            "THEN sort_array(transform(_h, (x, i) -> struct(x AS x, i AS i))) END"
        ),
    )
    placed = ranked.withColumn(
        "_p",
        F.expr(
            "sort_array(transform(filter(_s, (e, k) -> (k > 0 AND get(_s, k - 1).x = e.x) "
            "OR (k < size(_s) - 1 AND get(_s, k + 1).x = e.x)), e -> e.i))"
        ),
    )
    return placed.withColumn(
        "n_repeat_words",
        F.expr(
            f"CASE WHEN _p IS NULL THEN 0L ELSE aggregate(slice(_p, 2, size(_p)), "
            f"named_struct('n', {WINDOW}L, 'at', _p[0]), "
            f"(a, x) -> named_struct('n', a.n + least({WINDOW}, x - a.at), 'at', x)).n END"
        ),
    ).drop("_h", "_s", "_p")


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Measurements and the long `failed_bits`: bit k is set if rule k fails."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text, key).withColumn("failed_bits", bits)


def passes(policy: Policy, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """One row: for the policy and for each of its rules, documents removed, removed by
    that rule alone, and kept if the rule were dropped; also the bits that any and all
    documents fail. One pass of bitwise aggregates over the ledger."""
    seen = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    out = [
        F.count("*").alias("n_docs"),
        F.count_if(seen != 0).alias("removed"),
        F.bit_or(seen).alias("any_bits"),
        F.bit_and(seen).alias("all_bits"),
    ]
    for name in policy.rules:
        bit = mask((name,))
        out += [
            F.count_if(seen.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"{name}_fails"),
            F.count_if(seen == bit).alias(f"{name}_alone"),
        ]
    return rows.agg(*out)


def quality_rules(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """Documents with measurements, failure bits, `base_failed` and the policy's `kept`."""
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return ledger(docs).withColumns({"base_failed": base, "kept": ~base & passes(policy)})
