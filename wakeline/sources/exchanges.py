"""Captured exchanges: event streams, provider messages, and the benchmark format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

PART = StructType(
    [
        StructField("type", StringType()), StructField("text", StringType()), StructField("call_id", StringType()),
        StructField("name", StringType()), StructField("arguments", StringType()), StructField("outcome", StringType()),
    ]
)
MESSAGE = StructType([StructField("id", StringType()), StructField("body", StructType([StructField("role", StringType()), StructField("parts", ArrayType(PART))]))])
EXCHANGE = StructType(
    [
        StructField("id", StringType()),
        StructField("at_us", LongType()),
        StructField("client", StructType([StructField(n, StringType()) for n in ("credential", "vendor", "model")])),
        StructField("request", StructType([StructField("messages", ArrayType(StringType()))])),
        StructField("response", StructType([StructField("messages", ArrayType(StringType())), StructField("stop", StringType())])),
    ]
)
# A block of a provider's message, as it comes over the wire.
BLOCK = StructType(
    [
        StructField("type", StringType()), StructField("text", StringType()), StructField("thinking", StringType()),
        StructField("id", StringType()), StructField("name", StringType()), StructField("input", StringType()),
        StructField("tool_use_id", StringType()), StructField("content", StringType()), StructField("is_error", StringType()), StructField("data", StringType()),
    ]
)


def rows_of_kind(spark: SparkSession, path: str, kind: str, schema: StructType) -> DataFrame:
    """Payload rows of one kind from a JSON-lines file with tagged rows; malformed lines fail the read."""
    envelope = StructType([StructField("kind", StringType()), *schema.fields])
    return spark.read.schema(envelope).option("mode", "FAILFAST").json(path).where(F.col("kind") == kind).drop("kind")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of_kind(spark, f"{folder}/messages.jsonl", "message", MESSAGE)


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of_kind(spark, f"{folder}/exchanges.jsonl", "exchange", EXCHANGE)


def refused(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Lines that do not parse, kept aside with their text."""
    kept = StructType([*schema.fields, StructField("_refused", StringType())])
    rows = spark.read.schema(kept).option("columnNameOfCorruptRecord", "_refused").json(path)
    return rows.where("_refused IS NOT NULL").select("_refused")


def sse_events(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, seq, event, data) of server-sent event streams.

    Lines end with CR, LF or both; a blank line ends an event; comments and other fields
    are passed over; an event without data, or not ended before the body is, is not sent.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(body), "^\\ufeff", ""), r"\r\n|\r", "\n")
    blocks = F.split(text, "\n\n+")
    # What follows the last blank line was never ended.
    ended = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    rows = bodies.select(key, F.posexplode(ended).alias("seq", "_block"))
    lines = F.split("_block", "\n")
    field = lambda name: F.transform(
        F.filter(lines, lambda x: x.rlike(f"^{name}(:|$)")), lambda x: F.regexp_replace(x, f"^{name}(?:: ?)?", "")
    )
    data = field("data")
    return rows.where(F.size(data) > 0).select(key, "seq", F.get(F.reverse(field("event")), F.lit(0)).alias("event"), F.array_join(data, "\n").alias("data"))


def reassembled(deltas: DataFrame, keys: list[str], seq: str, text: str) -> DataFrame:
    """Streamed pieces of each block joined in order."""
    pieces = F.array_sort(F.collect_list(F.struct(seq, text)))
    return deltas.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p[text]), "").alias("text"))


def merged_usage(events: DataFrame, key: str, seq: str, usage: str) -> DataFrame:
    """Token usage from start and delta events: the last value of each field wins; the
    prompt counts what was written to and read from the cache too. usage is JSON text."""
    fields = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    value = lambda f: F.get_json_object(usage, f"$.{f}").cast("long")
    last = events.groupBy(key).agg(*[F.max_by(value(f), F.when(value(f).isNotNull(), F.col(seq))).alias(f) for f in fields])
    cached = F.coalesce("cache_creation_input_tokens", F.lit(0)) + F.coalesce("cache_read_input_tokens", F.lit(0))
    return last.select(
        key,
        (F.col("input_tokens") + cached).alias("input"),
        F.col("output_tokens").alias("output"),
        F.coalesce("cache_read_input_tokens", F.lit(0)).alias("cache_read"),
        F.coalesce("cache_creation_input_tokens", F.lit(0)).alias("cache_write"),
    ).where("input IS NOT NULL AND output IS NOT NULL")


def canonical_parts(content) -> Column:
    """Canonical parts of a message's content, which is JSON text: a string or blocks.

    Kinds: text, reasoning (opaque if redacted), tool_call, server_call, tool_result,
    server_result; any other block, or one that lacks what its kind needs, is kept verbatim as
    unknown but for its cache marker, which moves between turns.
    """
    c = F.col(content) if isinstance(content, str) else content
    blocks = F.from_json(c, ArrayType(BLOCK))
    raw = F.from_json(c, ArrayType(StringType()))
    as_part = lambda kind, **v: F.struct(
        F.lit(kind).alias("type"),
        *[v.get(n, F.lit(None).cast("string")).alias(n) for n in ("text", "call_id", "name", "arguments", "outcome")],
    )
    # A marker object is flat; quotes inside a string are escaped, so only a key matches.
    marker = r',\s*"cache_control"\s*:\s*(\{[^{}]*\}|null)|"cache_control"\s*:\s*(\{[^{}]*\}|null)\s*,?\s*'
    failed = lambda b: F.when(b["is_error"] == "true", "error").otherwise("success")
    call = lambda b: b["id"].isNotNull() & b["name"].isNotNull() & b["input"].isNotNull()
    part = lambda b, i: (
        F.when((b["type"] == "text") & b["text"].isNotNull(), as_part("text", text=b["text"]))
        .when((b["type"] == "thinking") & b["thinking"].isNotNull(), as_part("reasoning", text=b["thinking"]))
        .when((b["type"] == "redacted_thinking") & b["data"].isNotNull(), as_part("reasoning", text=b["data"], outcome=F.lit("opaque")))
        .when((b["type"] == "tool_use") & call(b), as_part("tool_call", call_id=b["id"], name=b["name"], arguments=b["input"]))
        .when(b["type"].isin("server_tool_use", "mcp_tool_use") & call(b), as_part("server_call", call_id=b["id"], name=b["name"], arguments=b["input"]))
        .when((b["type"] == "tool_result") & b["tool_use_id"].isNotNull(), as_part("tool_result", call_id=b["tool_use_id"], text=b["content"], outcome=failed(b)))
        .when(b["type"].endswith("_tool_result") & b["tool_use_id"].isNotNull(), as_part("server_result", call_id=b["tool_use_id"], text=b["content"], outcome=failed(b)))
        .otherwise(as_part("unknown", text=F.regexp_replace(F.get(raw, i), marker, "")))
    )
    return F.when(c.startswith("["), F.transform(blocks, part)).otherwise(F.array(as_part("text", text=F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v"), c))))


def message_hash(role="role", parts="parts") -> Column:
    """Content address of a message."""
    return F.sha2(F.to_json(F.struct(F.col(role), F.col(parts))), 256)


def uncached_input(input_="input", read="cache_read", write="cache_write") -> Column:
    return F.col(input_) - F.col(read) - F.coalesce(F.col(write), F.lit(0))
