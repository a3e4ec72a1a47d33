"""Evidence, claims, carried content and small parts of operators, each with a twin that computes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import decode, text, urls, vectors
from wakeline.operators import extraction, filters, flow, identity, paging
from wakeline.sources.storage import table

DAY = 86_400_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


EVENTS = """e AS (SELECT event_id, user_id, event_type, (props->>'$.k')::BIGINT AS k, epoch_us(ts) AS "at" FROM events)"""


def content_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that carry two spans each, linked by matches to later views of ten resources by five agents."""
    e = _events(spark, sf_dir).where("k IS NOT NULL")
    writes = e.where("event_type = 'purchase'").selectExpr("event_id AS write", "k % 10 AS resource", "user_id % 5 AS writer", "at AS write_at", "array(event_id % 8, event_id % 7 + 8) AS spans")
    reads = e.where("event_type = 'view'").selectExpr("event_id AS read", "k % 10 AS resource", "user_id % 5 AS reader", "at AS read_at", "event_id AS exchange", "event_id % 2 AS part")
    found = e.where("event_type = 'view'").selectExpr("event_id AS match", "event_id % 15 AS origin", "event_id % 5 AS origin_agent", "event_id AS exchange", "event_id % 2 AS part")
    return flow.content_backed(found, writes, reads, 2 * DAY).select("match", "read", "write", "resource", "origin", "writer", "reader", "lag")


CONTENT_LINKS = f"""
WITH {EVENTS}, w AS (SELECT event_id AS write, k % 10 AS resource, user_id % 5 AS writer, "at" AS write_at, unnest([event_id % 8, event_id % 7 + 8]) AS origin FROM e WHERE event_type = 'purchase'),
r AS (SELECT event_id AS read, k % 10 AS resource, user_id % 5 AS reader, "at" AS read_at, event_id % 15 AS origin, event_id % 5 AS agent FROM e WHERE event_type = 'view')
SELECT read AS match, read, write, resource, origin, writer, reader, read_at - write_at AS lag FROM r JOIN w USING (resource, origin)
WHERE writer = agent AND writer <> reader AND read_at > write_at AND read_at - write_at <= {2 * DAY}"""


def written_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a user's events that lie within the ranges that its purchases write."""
    e = _events(spark, sf_dir)
    writes = e.where("event_type = 'purchase'").selectExpr("event_id AS write", "user_id AS message", "event_id % 3 AS part", "event_id % 40 AS start", "event_id % 40 + 30 AS end")
    spans = e.where("event_type = 'view'").selectExpr("event_id AS span", "user_id AS message", "event_id % 3 AS part", "event_id % 50 AS span_start", "event_id % 50 + event_id % 11 AS span_end")
    return extraction.carried_spans(writes, spans)


WRITTEN_SPANS = """
SELECT w.event_id AS write, s.event_id AS span FROM events w JOIN events s ON w.user_id = s.user_id AND w.event_id % 3 = s.event_id % 3
WHERE w.event_type = 'purchase' AND s.event_type = 'view' AND s.event_id % 50 >= w.event_id % 40 AND s.event_id % 50 + s.event_id % 11 <= w.event_id % 40 + 30"""

KINDS = list(identity.SPECIFICITY)


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two items of evidence an exchange, and what agents hold: both by the event's number."""
    e = _events(spark, sf_dir)
    kind = lambda c: F.element_at(F.array(*map(F.lit, KINDS)), (c % len(KINDS) + 1).cast("int"))
    items = e.select(F.col("event_id").alias("exchange"), F.explode(F.array(F.col("event_id"), F.col("event_id") * 5 + 1)).alias("n"))
    evidence = items.select("exchange", kind(F.col("n")).alias("kind"), F.concat(F.lit("v"), (F.col("n") % 400).cast("string")).alias("value"))
    held = e.select((F.col("user_id") * 2 + F.col("event_id") % 2).alias("agent"), kind(F.col("event_id") * 7).alias("kind"), F.concat(F.lit("v"), (F.col("event_id") * 7 % 600).cast("string")).alias("value"))
    return evidence, held


def evidence_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the holders of each exchange's most specific evidence make of it."""
    return identity.resolution(*_evidence(spark, sf_dir))


EVIDENCE = f"""
i AS (SELECT event_id AS exchange, unnest([event_id, event_id * 5 + 1]) AS n FROM events),
evidence AS (SELECT exchange, n % {len(KINDS)} AS rank, list_extract({KINDS}, (n % {len(KINDS)} + 1)::INT) AS kind, 'v' || n % 400 AS value FROM i),
held AS (SELECT user_id * 2 + event_id % 2 AS agent, list_extract({KINDS}, (event_id * 7 % {len(KINDS)} + 1)::INT) AS kind, 'v' || event_id * 7 % 600 AS value FROM events)"""
EVIDENCE_RESOLUTION = f"""
WITH {EVIDENCE},
most AS (SELECT DISTINCT exchange, kind, value FROM evidence QUALIFY rank = min(rank) OVER (PARTITION BY exchange)),
open AS (SELECT * FROM held WHERE kind <> 'harness_session' OR agent NOT IN (SELECT agent FROM held WHERE kind = 'harness_agent')),
h AS (SELECT exchange, count(DISTINCT agent) AS n, min(agent) AS agent, max(kind IN {identity.STRONG}) AS strong FROM most JOIN open USING (kind, value) GROUP BY exchange)
SELECT e.event_id AS exchange, agent, CASE WHEN n IS NULL THEN 'new' WHEN n = 1 THEN 'known' WHEN strong THEN 'merge' ELSE 'review' END AS outcome FROM events e LEFT JOIN h ON h.exchange = e.event_id"""


def evidence_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that even events derive and odd ones do not hold yet, of agents established by two kinds."""
    _, held = _evidence(spark, sf_dir)
    derived = _events(spark, sf_dir).where("event_type = 'view'").select((F.col("user_id") * 2).alias("agent"), F.lit("account").alias("kind"), F.concat(F.lit("v"), (F.col("event_id") % 600).cast("string")).alias("value"))
    return identity.new_evidence(derived, held).join(identity.established(held), "agent", "left_semi")


EVIDENCE_NEW = f"""
WITH {EVIDENCE},
sure AS (SELECT agent FROM held GROUP BY agent HAVING count(DISTINCT kind) >= 2 AND max(kind IN {identity.STRONG}))
SELECT * FROM (SELECT user_id * 2 AS agent, 'account' AS kind, 'v' || event_id % 600 AS value FROM events WHERE event_type = 'view' EXCEPT SELECT agent, kind, value FROM held)
WHERE agent IN (SELECT agent FROM sure)"""


def agent_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of each type of event of an agent, over the users merged into it."""
    e = _events(spark, sf_dir)
    merged = e.select("user_id").distinct().where("user_id % 10 <> 0").select(F.col("user_id").alias("id"), (F.col("user_id") - F.col("user_id") % 10).alias("canonical"))
    return identity.claims(e.select(F.col("user_id").alias("agent"), F.col("event_type").alias("claim"), "at"), merged)


AGENT_CLAIMS = """SELECT user_id - user_id % 10 AS agent, event_type AS claim, max(epoch_us(ts)) AS "at" FROM events GROUP BY ALL"""


def topics_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that events ask for and no purchase knows."""
    e = _events(spark, sf_dir).where("k IS NOT NULL").select(F.col("k").alias("topic"), "event_type", "user_id")
    return filters.topics_outside(e.select("topic").distinct(), e.where("event_type = 'purchase' AND user_id % 9 = 0").select("topic"))


TOPICS_MISSING = f"WITH {EVENTS} SELECT k AS topic FROM e WHERE k IS NOT NULL EXCEPT SELECT k FROM e WHERE event_type = 'purchase' AND user_id % 9 = 0"


def rules_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as rules, one in three built in, by their place in the list."""
    from pyspark.sql import Window

    rules = _events(spark, sf_dir).select(F.col("user_id").alias("rule"), (F.col("user_id") % 3 == 0).alias("builtin")).distinct()
    return rules.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*paging.rules_order())))


RULES_LISTED = """
SELECT *, row_number() OVER (ORDER BY builtin DESC, rule DESC) AS place FROM (SELECT DISTINCT user_id AS rule, user_id % 3 = 0 AS builtin FROM events)"""


def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found under a document written as a JSON string: the document, if that took escapes."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("text")).alias("j"))
    return d.select("doc_id", F.explode(decode.json_layers("j")).alias("layer")).select("doc_id", F.md5("layer").alias("digest"))


JSON_STRINGS = r"""SELECT doc_id, md5(text) AS digest FROM documents WHERE length(text) >= 16 AND regexp_matches(text, '[\x00-\x1F"\\]')"""


def _written(c: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def yaml_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as YAML scalars and read back."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(decode.yaml_unescape(_written(F.col("text")))).alias("digest"))


YAML_STRINGS = "SELECT doc_id, md5(text) AS digest FROM documents"


def short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of whole words of benchmark items that are short enough to be matched exactly."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.token_runs("text")).alias("run"))


SHORT_RUNS = r"""
WITH w AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_.-]+') AS w FROM benchmark),
i AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), n AS (SELECT *, unnest(range(0, len(w) - i + 1)) AS n FROM i)
SELECT DISTINCT item_id, run FROM (SELECT item_id, array_to_string(w[i:i + n], ' ') AS run FROM n WHERE n < 46) WHERE length(run) BETWEEN 24 AND 46"""


def page_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses as those of repositories, in four spellings."""
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    host, path = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.regexp_extract("url", "^[a-z]+://[^/]+(/[^/?#]+/[^/?#]+)", 1)
    spelt = (
        F.when(F.col("page_id") % 4 == 0, F.col("url"))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("git@"), host, F.lit(":"), F.ltrim(path, F.lit("/")), F.lit(".git")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("ssh://git@"), host, F.lit(":22"), path))
        .otherwise(F.concat(F.lit("https://me@"), F.upper(host), path, F.lit("/")))
    )
    return p.select("page_id", urls.repository(spelt).alias("repository"))


PAGE_REPOSITORIES = r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^/?#]+/[^/?#]+)', 1) AS path, url FROM pages WHERE url IS NOT NULL)
SELECT page_id, CASE WHEN path = '' OR (page_id % 4 = 0 AND regexp_matches(url, '^[a-z]+://[^/]+/[^/?#]+/[^/?#]+/[^?#]')) THEN NULL
  ELSE lower(host || path) END AS repository FROM p"""


def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded offline in batches: how far each vector is from that of its text said twice."""
    d = table(spark, sf_dir, "documents")
    once = vectors.embedded(d, "doc_id", "text")
    twice = vectors.embedded(d.select("doc_id", F.concat_ws(" ", "text", "text").alias("text")), "doc_id", "text", batch=7).withColumnRenamed("vector", "other")
    near = F.round(vectors.cosine("vector", "other"), 6)
    return once.join(twice, "doc_id").select("doc_id", F.size("vector").cast("long").alias("size"), F.when(vectors.norm("vector") > 0, near).alias("similarity"))


NAMES = [
    "content_links", "written_spans", "evidence_resolution", "evidence_new", "agent_claims", "topics_missing", "rules_listed",
    "json_strings", "yaml_strings", "short_runs", "page_repositories",
]
QUERIES = {n: globals()[n] for n in (*NAMES, "embedded_documents")}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES}
