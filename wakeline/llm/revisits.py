"""Resolution of not-modified revisits in web archives (operator 8).

A revisit record has no body: it says that the page had not changed. Each is resolved to
the latest earlier full response of its canonical URL (an as-of join), if their validators
agree, and gets that response's body and headers, updated by the revisit's own headers as
far as a 304 may update them.

The as-of join carries the last response forward in (time, id) order. Time is cut into
slots: windows run within (URL, slot), and one row per slot and URL, its last response,
carries over to later slots. A URL with a third of all records is so spread over its slots,
and only references are moved; headers and bodies are joined by record id afterwards.

Validators. Two entity tags agree if they are equal but for the weak mark `W/`. If the
revisit has no tag, its last-modified must equal the response's. If it has neither, its
payload digest must. With nothing to compare, it is not resolved.

Outcomes: resolved, no_response (none earlier), validator_mismatch, no_validator. The
latest earlier response decides; one further back is not tried, as the page had changed.

Records: record_id, url, at (long), kind (`response` or `revisit`), headers
(map<string,string>), digest, body. Header names are taken in lower case. Every record of
kind `response` counts as a full one: select those of status 200 before.

Defined results: records with a null URL or time are not resolved (no_response); at one
time, a response counts as earlier if its record_id is less; a null header map is empty;
repeated rows keep a row each; a URL without scheme or host is its own key, less fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import urls

SLOT = 3600
# Headers that a 304 response carries for the stored response to take over.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.coalesce(urls.canonical(c), F.regexp_replace(c, "(?s)#.*$", ""))


def lower_names(headers) -> Column:
    """Header map with lower-case names; of names that then are equal the last value stays."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    named = F.transform(pairs, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(last)


def strong(tag: Column) -> Column:
    """Entity tag without its weak mark."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers with the permitted ones of an update laid over them, in name order."""
    taken = F.map_filter(update, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(taken, k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, taken))))


def resolve(records: DataFrame, slot: int = SLOT) -> DataFrame:
    """One row per revisit: record_id, canonical, at, response_id, outcome, headers, digest, body."""
    named = records.select(
        "record_id", "kind", "at", canonical_url("url").alias("canonical"), lower_names(F.col("headers")).alias("headers"), "digest", "body"
    )
    refs = named.select(
        "record_id",
        "kind",
        "at",
        "canonical",
        F.floor(F.col("at") / slot).alias("_slot"),
        F.col("headers")["etag"].alias("etag"),
        F.col("headers")["last-modified"].alias("modified"),
        "digest",
    )
    known = refs.where("canonical IS NOT NULL AND at IS NOT NULL")
    full = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "modified", "digest"))
    order = ["at", "record_id"]
    within = Window.partitionBy("canonical", "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = known.withColumn("_here", F.last(full, ignorenulls=True).over(within)).where("kind = 'revisit'")
    # The last response of each slot, carried into later slots: one row per URL and slot.
    ends = known.groupBy("canonical", "_slot").agg(F.max_by(full, F.when(F.col("kind") == "response", F.struct(*order))).alias("_end"))
    across = Window.partitionBy("canonical").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("canonical", "_slot", F.last("_end", ignorenulls=True).over(across).alias("_before"))
    found = here.join(before, ["canonical", "_slot"], "left").withColumn("_r", F.coalesce("_here", "_before"))
    agrees = (
        F.when(F.col("etag").isNotNull() & F.col("_r.etag").isNotNull(), strong(F.col("etag")) == strong(F.col("_r.etag")))
        .when(F.col("modified").isNotNull() & F.col("_r.modified").isNotNull(), F.col("modified") == F.col("_r.modified"))
        .when(F.col("digest").isNotNull() & F.col("_r.digest").isNotNull(), F.col("digest") == F.col("_r.digest"))
    )
    outcome = (
        F.when(F.col("_r").isNull(), "no_response")
        .when(agrees.isNull(), "no_validator")
        .when(agrees, "resolved")
        .otherwise("validator_mismatch")
    )
    judged = found.select("record_id", "canonical", "at", F.col("_r.record_id").alias("_response"), outcome.alias("outcome"))
    lost = refs.where("kind = 'revisit' AND (canonical IS NULL OR at IS NULL)").select(
        "record_id", "canonical", "at", F.lit(None).cast("long").alias("_response"), F.lit("no_response").alias("outcome")
    )
    rows = judged.unionByName(lost).withColumn("response_id", F.when(F.col("outcome") == "resolved", F.col("_response"))).drop("_response")
    own = named.where("kind = 'revisit'").select("record_id", F.col("headers").alias("_own")).dropDuplicates(["record_id"])
    stored = named.where("kind = 'response'").select(
        F.col("record_id").alias("response_id"), F.col("headers").alias("_stored"), F.col("digest").alias("_digest"), F.col("body").alias("_body")
    ).dropDuplicates(["response_id"])
    # Unresolved revisits do not take part: with no id to join by, they would all meet in one task.
    both = rows.join(own, "record_id", "left")
    plain = both.where("response_id IS NULL").withColumns({c: F.lit(None).cast(t) for c, t in stored.dtypes if c != "response_id"})
    joined = both.where("response_id IS NOT NULL").join(stored, "response_id", "left").unionByName(plain)
    return joined.select(
        "record_id", "canonical", "at", "response_id", "outcome",
        F.when(F.col("response_id").isNotNull(), merged_headers(F.col("_stored"), F.col("_own"))).alias("headers"),
        F.col("_digest").alias("digest"), F.col("_body").alias("body"),
    )


def archive_of(pages: DataFrame) -> DataFrame:
    """Archive records of pages: four pages are captures of the first one's URL.

    Each but the third was fetched in full, and each was asked for again at another time:
    seconds or slots later, after later fetches, or before any. The tables hold no headers,
    so validators are made from the URL: most revisits repeat the entity tag, some weakly;
    some have another tag, some only a date, some none, as have some responses.
    """
    heads = pages.where("page_id % 4 = 0").select(F.expr("page_id DIV 4").alias("g"), F.col("url").alias("head"))
    rows = pages.withColumn("g", F.expr("page_id DIV 4")).join(heads, "g").selectExpr(
        "page_id AS p", "g", "head", "html", "g * 20000 + page_id % 4 * 5000 AS at",
        "g * 20000 + page_id % 4 * 5000 + CASE page_id % 7 WHEN 0 THEN 5 WHEN 1 THEN 900 WHEN 2 THEN 4000 WHEN 3 THEN 9000 WHEN 4 THEN -300 WHEN 5 THEN 90000 ELSE 13 END AS again",
    )
    tag = F.concat(F.lit('"'), F.md5("head"), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("g") % 9).cast("string"))
    p = F.col("p")
    full = rows.where("p % 4 <> 2").select(
        (p * 2).alias("record_id"), F.col("head").alias("url"), "at", F.lit("response").alias("kind"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.when(p % 5 != 4, tag), F.lit("Last-Modified"), date,
                     F.lit("Date"), F.col("at").cast("string")).alias("headers"),
        F.md5("html").alias("digest"), F.col("html").alias("body"),
    )
    own = F.when(p % 6 == 0, F.concat(F.lit("W/"), tag)).when(p % 6 == 1, F.lit('"other"')).when(p % 6 < 4, tag)
    asked = rows.select(
        (p * 2 + 1).alias("record_id"), F.concat("head", F.lit("#again")).alias("url"), F.col("again").alias("at"), F.lit("revisit").alias("kind"),
        F.create_map(F.lit("etag"), own, F.lit("Last-Modified"), F.when(p % 6 == 5, date), F.lit("Date"), F.col("again").cast("string"),
                     F.lit("Content-Type"), F.lit("text/plain")).alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("body"),
    )
    return full.unionByName(asked)


def digest(resolved: DataFrame) -> DataFrame:
    """Rows without bodies; response_id is -1 and body_bytes 0 where there is no response."""
    return resolved.select(
        "record_id", "canonical", F.coalesce("response_id", F.lit(-1).cast("long")).alias("response_id"), "outcome",
        F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";").alias("headers"),
        F.md5("body").alias("body_md5"), F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("body_bytes"),
    )
