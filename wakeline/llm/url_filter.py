"""URL filtering by rules first, then gradient-boosted trees on lexical features (operator 2).

Rules name a host and a path; the longest that fits a URL decides it. URLs that a rule
decides are labelled, and train the trees that judge all others. Features are lexical:
lengths, depth, digit ratio, entropy, parameter counts, and statistics of host suffixes
(how often labelled URLs under a suffix, a site's name, and a first path segment were
blocked). Both classes weigh the same in the fit, whatever their counts.

The fit uses at most `MAX_LABELLED` labelled URLs, the first by a seeded hash of the URL;
suffix statistics are counts over every labelled URL, kept for suffixes seen at least
`SUFFIX_SEEN` times and joined in Spark. A labelled URL's own vote is left out of its
suffix statistics, so they cannot simply repeat its label.

Defined results: a null URL or one without `://` has empty host and path, matches no rule
and is judged by the trees like any other; if the labels have no block, or no allow, the
verdict for the rest is the one label there is (`allow` if there is none). Repeated rows
are judged alike; other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

MAX_LABELLED = 20_000
SUFFIX_SEEN = 2
SEED = 11
STATISTICS = ("suffix", "label", "section")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, _, path = text.partition("/")
    return Rule(verdict, host, f"/{path}")


PRODUCTION = (
    rule("allow", "com/"),
    rule("block", "example.com/en/"),
    rule("allow", "www.example.com/en/"),
    rule("block", "net/es/"),
    rule("block", "net/fr/"),
)

FEATURES = (
    "url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "host_digits", "hyphens",
    "host_entropy", "path_entropy", "parameters", "query_length", "fragment", "secure", "suffix_score", "suffix_seen",
    "label_score", "label_seen", "section_score", "section_seen",
)


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, and the host and path as the rules see them."""
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.select(
        "page_id", "url", F.coalesce(lower, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")
    )


def longest_rule(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def entropy(text: str) -> Column:
    """Bits per character, from the distinct characters of a column."""
    return F.expr(
        f"CASE WHEN length({text}) = 0 THEN 0D ELSE aggregate(array_distinct(split({text}, '')), 0D, (a, c) -> "
        f"a - ((length({text}) - length(replace({text}, c, ''))) / length({text})) "
        f"* log2((length({text}) - length(replace({text}, c, ''))) / length({text}))) END"
    )


def lexical(rows: DataFrame) -> DataFrame:
    u = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")).cast("double")
    return rows.withColumns(
        {
            "url_length": F.length(u).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "host_labels": F.size(F.split("host", r"\.")).cast("double"),
            "path_depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digit_ratio": digits(u) / F.greatest(F.length(u), F.lit(1)),
            "host_digits": digits("host"),
            "hyphens": (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"),
            "host_entropy": entropy("host"),
            "path_entropy": entropy("path"),
            "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
            "query_length": F.length(query).cast("double"),
            "fragment": F.contains(u, F.lit("#")).cast("double"),
            "secure": F.startswith(u, F.lit("https:")).cast("double"),
            "suffix": F.substring_index("host", ".", -2),
            "section": F.substring_index(F.substring_index("path", "/", 2), "/", -1),
            "label": F.substring_index(F.substring_index("host", ".", -3), ".", 1),
        }
    )


def with_statistics(rows: DataFrame, key: str) -> DataFrame:
    """Smoothed share of blocks among labelled URLs of equal key, an URL's own label left out."""
    known = F.col("verdict").isNotNull()
    stats = (
        rows.where(known)
        .groupBy(key)
        .agg(F.count("*").alias("_n"), F.count_if(F.col("verdict") == "block").alias("_b"))
        .where(F.col("_n") >= SUFFIX_SEEN)
    )
    own = F.when(known, 1).otherwise(0)
    n = F.coalesce("_n", F.lit(0)) - F.when(F.col("_n").isNotNull(), own).otherwise(0)
    b = F.coalesce("_b", F.lit(0)) - F.when(F.col("_n").isNotNull() & (F.col("verdict") == "block"), 1).otherwise(0)
    return rows.join(stats, key, "left").withColumns(
        {f"{key}_score": (b + 1) / (n + 2.0), f"{key}_seen": F.log1p(n.cast("double"))}
    ).drop("_n", "_b")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = PRODUCTION, most: int = MAX_LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' probability of block."""
    name, verdict = longest_rule(rules)
    ruled = lexical(parts(pages)).withColumns({"rule": name, "verdict": verdict})
    for key in STATISTICS:
        ruled = with_statistics(ruled, key)
    rows = checkpoint(ruled.select("page_id", "url", "host", "path", "rule", "verdict", *FEATURES))
    labelled = rows.where("verdict IS NOT NULL")
    sides = {r["verdict"]: r["count"] for r in labelled.groupBy("verdict").count().collect()}
    if len(sides) < 2:
        chance = F.lit(1.0 if "block" in sides else 0.0)
        judged = rows.withColumn("block_chance", chance)
    else:
        # The rows with the smallest seeded hashes; the order settles ties, so fits repeat.
        sample = (
            labelled.select(*FEATURES, (F.col("verdict") == "block").cast("double").alias("y"), F.xxhash64(F.lit(SEED), "url").alias("_h"), "page_id")
            .orderBy("_h", "page_id")
            .limit(most)
        )
        into = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
        weight = F.when(F.col("y") == 1, 0.5 / sides["block"]).otherwise(0.5 / sides["allow"]) * sum(sides.values())
        train = checkpoint(into.transform(sample).select("x", "y", weight.alias("w")).coalesce(1))
        trees = GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=12, maxDepth=4, maxBins=32, stepSize=0.2, seed=SEED).fit(train)
        scored = trees.transform(into.transform(rows))
        judged = scored.withColumn("block_chance", vector_to_array("probability")[1])
    final = F.coalesce("verdict", F.when(F.col("block_chance") >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", final.alias("verdict"), "block_chance")
