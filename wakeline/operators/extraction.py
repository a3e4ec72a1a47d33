"""Resources that tool calls read and write.

Calls are rows (call, tool, args, at, ...) with arguments as JSON text. Tools are found in
a catalogue joined as a small table; only shell commands need a procedure (`shell`), which
runs over the few rows that hold one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.jsons import first_of
from wakeline.functions.urls import host, joined_path, locator, path, repository, with_scheme
from wakeline.functions.text import wiki_title
from wakeline.sources.storage import small

from . import shell

# Fixed values: (tool, family, operation, argument keys in order of preference).
CATALOGUE = (
    ("Read", "file", "read", "file_path"),
    ("Write", "file", "write", "file_path"),
    ("Edit", "file", "write", "file_path"),
    ("MultiEdit", "file", "write", "file_path"),
    ("NotebookEdit", "file", "write", "notebook_path"),
    ("NotebookRead", "file", "read", "notebook_path"),
    ("read", "file", "read", "filePath path file_path"),
    ("write", "file", "write", "filePath path file_path"),
    ("edit", "file", "write", "filePath path file_path"),
    ("read_file", "file", "read", "absolute_path file_path path"),
    ("write_file", "file", "write", "file_path path"),
    ("replace", "file", "write", "file_path path"),
    ("str_replace_based_edit_tool", "file", "by_command", "path"),
    ("str_replace_editor", "file", "by_command", "path"),
    ("WebFetch", "fetch", "read", "url"),
    ("web_fetch", "fetch", "read", "url prompt"),
    ("webfetch", "fetch", "read", "url"),
    ("http_request", "http", "by_method", "url"),
    ("Bash", "shell", "shell", "command"),
    ("bash", "shell", "shell", "command"),
    ("run_shell_command", "shell", "shell", "command"),
    ("execute_bash", "shell", "shell", "command"),
    ("shell", "shell", "shell", "command"),
    ("exec_command", "shell", "shell", "cmd"),
)
# Editor commands by what they do.
EDITOR_READS = ("view",)
EDITOR_WRITES = ("create", "str_replace", "insert", "undo_edit")
KEYS = ("file_path", "filePath", "path", "absolute_path", "notebook_path", "url", "prompt", "command", "cmd")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, f, o, k.split()) for t, f, o, k in CATALOGUE], "tool string, family string, operation string, keys array<string>")


def identified(calls: DataFrame) -> DataFrame:
    """Calls with family, operation and main argument; tools named mcp__server__tool are of
    family mcp; calls of unknown tools are left out."""
    known = calls.join(F.broadcast(catalogue(calls.sparkSession)), "tool", "left")
    mcp = r"^mcp__(.+?)__(.+)$"
    server = F.regexp_extract("tool", mcp, 1)
    present = F.array(*[F.struct(F.lit(k).alias("key"), F.get_json_object("args", f"$['{k}']").alias("value")) for k in KEYS])
    # Keys in the tool's order of preference, the first that is present.
    values = F.filter(
        F.transform("keys", lambda k: F.element_at(F.filter(present, lambda p: p["key"] == k), 1)["value"]), lambda v: v.isNotNull()
    )
    return known.withColumns(
        {
            "family": F.when(server != "", "mcp").otherwise(F.col("family")),
            "server": F.nullif(server, F.lit("")),
            "mcp_tool": F.nullif(F.regexp_extract("tool", mcp, 2), F.lit("")),
            "argument": F.get(values, F.lit(0)),
        }
    ).where("family IS NOT NULL").drop("keys")


def operation_of(method="method") -> Column:
    """What a request method does; others neither read nor write."""
    m = F.upper(F.col(method) if isinstance(method, str) else method)
    return F.when(m.isin(*shell.READING), "read").when(m.isin(*shell.WRITING), "write")


def file_accesses(found: DataFrame) -> DataFrame:
    """(call, op, locator) of file tools; an editor's command decides what it does."""
    command = F.get_json_object("args", "$.command")
    op = (
        F.when(F.col("operation") != "by_command", F.col("operation"))
        .when(command.isin(*EDITOR_READS), "read")
        .when(command.isin(*EDITOR_WRITES), "write")
    )
    base = F.coalesce(F.col("cwd"), F.lit("/")) if "cwd" in found.columns else F.lit("/")
    rows = found.where("family = 'file' AND argument IS NOT NULL").withColumn("op", op).where("op IS NOT NULL")
    return rows.select("call", "op", F.concat(F.lit("file:"), joined_path(base, F.col("argument"))).alias("locator"))


def fetch_accesses(found: DataFrame) -> DataFrame:
    """(call, op, locator) of fetch and HTTP tools."""
    method = F.coalesce(F.get_json_object("args", "$.method"), F.lit("GET"))
    op = F.when(F.col("operation") == "by_method", operation_of(method)).otherwise("read")
    url = F.regexp_extract("argument", r"(https?://[^\s\"'<>]+|^[^\s]+$)", 1)
    rows = found.where("family IN ('fetch', 'http') AND argument IS NOT NULL").withColumns({"op": op, "_u": url})
    return rows.where("op IS NOT NULL AND _u <> ''").select("call", "op", locator("_u").alias("locator"))


def mcp_accesses(found: DataFrame, rules: DataFrame) -> DataFrame:
    """(call, op, locator) by configured rules: (server, mcp_tool, op, key), few rows."""
    rows = found.where("family = 'mcp'").join(small(rules.withColumnRenamed("op", "_op")), ["server", "mcp_tool"])
    values = F.from_json("args", "map<string,string>")
    target = F.element_at(values, F.col("key"))
    return rows.withColumn("_v", target).where("_v IS NOT NULL").select(
        "call", F.col("_op").alias("op"), F.concat_ws(":", F.lit("mcp"), "server", "_v").alias("locator")
    )


def site_key(url) -> Column:
    """Key of a page on a site of a known kind: a wiki page or a repository; null elsewhere."""
    wiki = F.regexp_extract(path(url), r"^/wiki/(.+)$", 1)
    forge = host(url).isin("github.com", "gitlab.com")
    return F.when(wiki != "", F.concat(F.lit("wiki:"), host(url), F.lit(":"), wiki_title(F.try_url_decode(wiki)))).when(
        forge, F.concat(F.lit("repo:"), repository(F.regexp_replace(url, r"^(https?://[^/]+/[^/]+/[^/?#]+).*$", "$1")))
    )


# How commands say that they failed, or worked.
FAILURES = {
    "git_push": r"(?m)^\s*(?:fatal:|error:| ?! \[(?:remote )?rejected\])",
    "git_transfer": r"(?m)^\s*(?:fatal:|error:)",
    "http": r"(?m)^\s*curl: \(",
    "forge": r"(?m)^\s*(?:error|failed|X )|\(HTTP [45][0-9]{2}\)\s*$",
}
WORKED = {"git_push": r"(?m)^\s*(?:[+* ]?\s*\S+\.\.\S+\s+\S+ -> \S+|\* \[new (?:branch|tag)\])", "forge": r"(?m)^\s*(?:https://|✓)"}


def outcome(status="status", command="command", text="text") -> Column:
    """delivered, rejected or unknown, from the tool's own word and its command's output."""
    said, kind, t = F.col(status), F.col(command), F.coalesce(F.col(text), F.lit(""))
    code = F.regexp_extract(t, r"(?m)(?:HTTP/[0-9.]+ |^\s*)([1-5][0-9]{2})\b[^\n]*\s*$", 1)
    judged = (
        F.when((kind == "git_push") & t.rlike(FAILURES["git_push"]), "rejected")
        .when((kind == "git_push") & t.rlike(WORKED["git_push"]), "delivered")
        .when(kind == "git_push", "unknown")
        .when((kind == "git_transfer") & t.rlike(FAILURES["git_transfer"]), "rejected")
        .when((kind == "http") & (t.rlike(FAILURES["http"]) | (code >= "400")), "rejected")
        .when((kind == "http") & (code != ""), "delivered")
        .when((kind == "forge") & t.rlike(FAILURES["forge"]), "rejected")
        .when((kind == "forge") & t.rlike(WORKED["forge"]), "delivered")
    )
    return (
        F.when(said.isNull(), "unknown")
        .when(said == "error", "rejected")
        .otherwise(F.coalesce(judged, F.when(said == "success", "delivered").otherwise("unknown")))
    )


def carried_spans(writes: DataFrame, spans: DataFrame) -> DataFrame:
    """Writes with the spans that lie within the written part's range: (write, span)."""
    inside = (F.col("span_start") >= F.col("start")) & (F.col("span_end") <= F.col("end"))
    return writes.join(spans, ["message", "part"]).where(inside).select("write", "span")


def shell_accesses(found: DataFrame, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """(call, step, op, kind, target) of shell tools.

    With keys and an order, calls of one conversation run in one shell: folders and clones
    go from each to the next. Rows are sorted by them and pass one at a time with the state
    of one shell, so a conversation of any length needs no memory. A call that names its
    folder (column cwd) starts there.
    """
    keys = keys or []

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at = None, shell.Shell()
        for part in parts:
            rows = []
            for r in part.to_dict("records"):
                who = tuple(r[k] for k in keys) if keys else r["call"]
                if who != last:
                    last, at = who, shell.Shell()
                if isinstance(r["cwd"], str):
                    at.cwd = r["cwd"]
                rows += [(r["call"], i, *a) for i, a in enumerate(shell.accesses(r["argument"], at))]
            yield pd.DataFrame(rows, columns=["call", "step", "op", "kind", "target"])

    start = F.col("cwd") if "cwd" in found.columns else F.lit(None)
    calls = found.where("family = 'shell' AND argument IS NOT NULL").select(
        F.col("call").cast("string").alias("call"), "argument", start.cast("string").alias("cwd"), *keys, *([order] if order else [])
    )
    if keys:
        calls = calls.repartition(*keys).sortWithinPartitions(*keys, *([order] if order else []))
        # As text, since pandas would make floats of long keys beside a null; it keeps the order.
        calls = calls.withColumns({k: F.col(k).cast("string") for k in keys})
    return calls.mapInPandas(go, "call string, step int, op string, kind string, target string")
