"""Precision rules, tool extraction and streams of exchanges on the supplied tables.

Benchmark items stand for origins' spans and documents for what readers read; documents
belong to five agents by their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import text
from wakeline.operators import extraction, precision, provenance
from wakeline.sources import exchanges
from wakeline.sources.storage import checkpoint, table

from .text_queries import COPIED_RUNS, GRAMS, copied_runs, _docs

AGENTS = 5


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.grams(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "origin")


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams of documents that some item has: (doc, fp, pos)."""
    found = provenance.shared_grams(_docs(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")
    return checkpoint(found.withColumnRenamed("doc_id", "doc"))


def _hits(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """Hits (origin, doc, fp, reader, read_at, carrier, forwarded)."""
    held = (held or _held(spark, sf_dir)).withColumnRenamed("doc", "reader")
    found = provenance.matches(_items(spark, sf_dir), held, provenance.document_frequency(held, "reader"))
    return found.select(
        "origin", F.col("reader").alias("doc"), "fp", (F.col("reader") % AGENTS).alias("reader"), F.col("reader").alias("read_at"),
        F.when(F.col("reader") % 2 == 0, "tool_result").otherwise("user_turn").alias("carrier"), (F.col("origin") % 3 == 0).alias("forwarded"),
    )


HITS = f"""
WITH {GRAMS}, held AS (SELECT doc_id AS doc, fp FROM d WHERE fp IN (SELECT fp FROM b)),
stop AS (SELECT fp FROM held GROUP BY fp HAVING count(DISTINCT doc) > {provenance.CUTOFF}),
hits AS (SELECT item_id AS origin, doc, fp, doc % {AGENTS} AS reader FROM b JOIN held USING (fp) WHERE fp NOT IN (SELECT fp FROM stop))
"""


def live_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by item and document, items being indexed one after another and expiring."""
    o = F.col("origin")
    spans = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("origin")).select(
        o.alias("span"), (o % AGENTS).alias("agent"), (o * 10).alias("indexed_at"), (o * 10 + 600).alias("expires_at")
    )
    found = precision.live_hits(_hits(spark, sf_dir).withColumnRenamed("origin", "span"), spans)
    return found.groupBy("span", "doc").agg(F.count("*").alias("hits"))


LIVE_HITS = HITS + f"""
SELECT origin AS span, doc, count(*) AS hits FROM hits
WHERE origin % {AGENTS} <> reader AND origin * 10 <= doc AND doc < origin * 10 + 600 GROUP BY ALL"""


def own_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits left once grams that the reader had in an earlier document do not count."""
    held = _held(spark, sf_dir)
    own = held.select((F.col("doc") % AGENTS).alias("reader"), "fp", F.col("doc").alias("at"))
    return precision.without_replays(_hits(spark, sf_dir, held), own).groupBy("origin", "doc").agg(F.count("*").alias("hits"))


OWN_REPLAYS = HITS + f"""
, own AS (SELECT doc % {AGENTS} AS reader, fp, min(doc) AS own_at FROM held GROUP BY ALL)
SELECT origin, doc, count(*) AS hits FROM hits LEFT JOIN own USING (reader, fp)
WHERE NOT ((doc % 2 = 0 OR origin % 3 = 0) AND own_at < doc) GROUP BY ALL"""


def forward_direct_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits left once readers of an item's later part, which its forwarder left out, do not count."""
    items = _items(spark, sf_dir).withColumnRenamed("origin", "forward")
    only = precision.source_only(items, items.where("pos < 40"))
    held = _held(spark, sf_dir)
    reads = held.where("doc % 3 = 0").select((F.col("doc") % AGENTS).alias("reader"), F.col("doc").alias("layer"), "fp")
    hits = _hits(spark, sf_dir, held).withColumnRenamed("origin", "forward")
    return precision.without_direct_reads(hits, reads, only).groupBy("forward", "doc").agg(F.count("*").alias("hits"))


FORWARD_DIRECT_READS = HITS + f"""
, rest AS (SELECT DISTINCT item_id AS forward, fp FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.item_id = x.item_id AND y.fp = x.fp AND y.pos < 40)),
reads AS (SELECT DISTINCT doc % {AGENTS} AS reader, doc AS layer, fp FROM held WHERE doc % 3 = 0),
direct AS (SELECT reader, forward, layer FROM reads JOIN rest USING (fp) GROUP BY ALL HAVING count(*) >= {provenance.WINDOW}),
explained AS (SELECT DISTINCT reader, forward, fp FROM direct JOIN reads USING (reader, layer))
SELECT origin AS forward, doc, count(*) AS hits FROM hits h
WHERE NOT EXISTS (SELECT 1 FROM explained e WHERE e.reader = h.reader AND e.forward = h.origin AND e.fp = h.fp) GROUP BY ALL"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged copied runs with the document's text: (reader, origin, start, end, text)."""
    merged = provenance.merged_intervals(copied_runs(spark, sf_dir), ["reader", "origin"])
    return merged.join(_docs(spark, sf_dir).select(F.col("doc_id").alias("reader"), "text"), "reader")


TOKENS = r"list_filter(regexp_extract_all(regexp_replace(lower({0}), '\s+', ' ', 'g'), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 4 OR regexp_matches(t, '\p{{N}}'))"
FRONT = r"""regexp_replace(substr(text, greatest(start, 1), least("end" + 1, length(text)) - greatest(start, 1) + 1), CASE WHEN start > 0 THEN '^[\p{L}\p{N}]+' ELSE '^$' END, '')"""
WHOLE = rf"""regexp_replace({FRONT}, CASE WHEN "end" < length(text) THEN '[\p{{L}}\p{{N}}]+\z' ELSE '^$' END, '')"""
RUNS = f"WITH runs AS ({COPIED_RUNS}), " + f"""
cells AS (SELECT DISTINCT reader, origin, unnest(range(start, "end")) AS p FROM runs),
islands AS (SELECT *, p - row_number() OVER (PARTITION BY reader, origin ORDER BY p) AS g FROM cells),
merged AS (SELECT reader, origin, min(p) AS start, max(p) + 1 AS "end" FROM islands GROUP BY reader, origin, g),
cut AS (SELECT merged.*, text, {TOKENS.format(WHOLE)} AS w FROM merged JOIN documents ON doc_id = reader)
"""


def inherited_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items copied by odd documents as text that even documents had given; an item stands
    for a third of its agent's message."""
    runs, b = _runs(spark, sf_dir), table(spark, sf_dir, "benchmark")
    given = runs.where("reader % 2 = 0").select(F.col("origin").alias("exchange"), F.col("reader").alias("part"), "text").distinct()
    length = b.select(F.col("item_id").alias("origin"), (3 * F.length("text")).alias("span_length"))
    judged = runs.where("reader % 2 = 1").join(length, "origin").withColumns({"match": F.struct("reader", "origin"), "exchange": F.col("origin")})
    return precision.inherited(judged, given).select("match.reader", "match.origin")


INHERITED_FRAGMENTS = RUNS + f"""
, given AS (SELECT DISTINCT origin, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' AS part FROM cut WHERE reader % 2 = 0),
ok AS (
  SELECT reader, origin FROM cut JOIN benchmark b ON b.item_id = origin WHERE reader % 2 = 1
  GROUP BY ALL HAVING 2 * sum("end" - start) < max(3 * length(b.text)) AND min(len(w)) >= 2),
each AS (
  SELECT reader, origin, start, coalesce(bool_or(contains(part, ' ' || array_to_string(w, ' ') || ' ')), false) AS held
  FROM cut JOIN ok USING (reader, origin) LEFT JOIN given USING (origin) GROUP BY ALL)
SELECT reader, origin FROM each GROUP BY ALL HAVING bool_and(held)"""


def reader_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of documents that repeat an item at length and hold a token rare enough."""
    runs = _runs(spark, sf_dir)
    holders = runs.groupBy("origin").agg(F.count_distinct("reader").alias("holders"))
    rows = runs.join(holders, "origin").withColumns({"stretch": F.struct("reader", "origin", "start", "end"), "hits": F.lit(1)})
    words = _docs(spark, sf_dir).select(F.explode(F.array_distinct(text.tokens(text.normalize(F.col("text"))))).alias("token"))
    found = precision.reader_outputs(rows, words.groupBy("token").agg(F.count("*").alias("texts")))
    return found.select("stretch.*")


READER_OUTPUTS = RUNS + rf"""
, freq AS (SELECT token, count(*) AS texts FROM (SELECT doc_id, unnest(list_distinct({TOKENS.format('text')})) AS token FROM documents) GROUP BY token),
holders AS (SELECT origin, count(DISTINCT reader) AS holders FROM cut GROUP BY origin),
each AS (
  SELECT reader, origin, start, "end", unnest(w) AS token FROM cut
  WHERE length(trim(regexp_replace(lower(substr(text, start + 1, "end" - start)), '\s+', ' ', 'g'))) >= {provenance.LONG_RUN})
SELECT DISTINCT reader, origin, start, "end" FROM each JOIN freq USING (token) JOIN holders USING (origin) WHERE texts <= 2 * holders + 1"""


def tool_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes of tool calls made from pages: files, an editor, fetches, requests,
    a configured server and shell commands."""
    p, k = table(spark, sf_dir, "pages").select("page_id", "url"), F.col("page_id").cast("string")
    args = lambda **v: F.to_json(F.struct(*[(c if not isinstance(c, str) else F.lit(c)).alias(n) for n, c in v.items()]))
    file = F.concat(F.lit("/a/../data//"), k, F.lit(".txt"))
    shape = [
        ("Read", args(file_path=file)),
        ("str_replace_editor", args(command="create", path=file)),
        ("WebFetch", args(url=F.concat(F.lit("HTTPS://Host/"), k, F.lit("?b=2&a=1")))),
        ("http_request", args(url=F.concat(F.lit("https://host/"), k), method=F.when(F.col("page_id") % 4 == 3, "put").otherwise("HEAD"))),
        ("mcp__wiki__edit", args(title=F.concat(F.lit("Page "), k))),
        ("Bash", args(command=F.concat(F.lit("cat in.txt | tee out_"), k, F.lit(".txt && curl -X POST https://host/"), k))),
        ("unheard_of", args(path=file)),
    ]
    pick = lambda i: F.element_at(F.array(*[s[i] if i else F.lit(s[0]) for s in shape]), (F.col("page_id") % len(shape) + 1).cast("int"))
    found = extraction.identified(p.select(F.col("page_id").alias("call"), pick(0).alias("tool"), pick(1).alias("args")))
    rules = spark.createDataFrame([("wiki", "edit", "write", "title")], "server string, mcp_tool string, op string, key string")
    shell = extraction.shell_accesses(found).select(F.col("call").cast("long").alias("call"), "op", F.concat_ws(":", "kind", "target").alias("locator"))
    return extraction.file_accesses(found).unionByName(extraction.fetch_accesses(found)).unionByName(extraction.mcp_accesses(found, rules)).unionByName(shell)


TOOL_ACCESSES = """
WITH p AS (SELECT page_id AS call, page_id % 7 AS kind FROM pages)
SELECT call, CASE kind WHEN 0 THEN 'read' ELSE 'write' END AS op, 'file:/data/' || call || '.txt' AS locator FROM p WHERE kind < 2
UNION ALL SELECT call, 'read', 'https://host/' || call || '?a=1&b=2' FROM p WHERE kind = 2
UNION ALL SELECT call, CASE WHEN call % 4 = 3 THEN 'write' ELSE 'read' END, 'https://host/' || call FROM p WHERE kind = 3
UNION ALL SELECT call, 'write', 'mcp:wiki:Page ' || call FROM p WHERE kind = 4
UNION ALL SELECT call, op, what || CASE WHEN op = 'read' THEN '' WHEN what = 'url:https://host/' THEN '' || call ELSE call || '.txt' END
FROM p, (VALUES ('read', 'file:in.txt'), ('write', 'file:out_'), ('write', 'url:https://host/')) s(op, what) WHERE kind = 5"""


def shell_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell calls of four pages to a conversation: the second starts where the first went,
    the third pushes the clone of the second, the fourth reads a file beside it."""
    k, conversation = F.col("page_id"), F.floor(F.col("page_id") / 4)
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    line = (
        F.when(k % 4 == 0, text("mkdir -p /srv/", conversation, " && cd /srv/", conversation))
        .when(k % 4 == 1, text("git clone https://git.example/team/r", conversation, ".git repo; cat notes.md | wc -l"))
        .when(k % 4 == 2, text("cd repo && cat <<END > out.md\ncat ", k, "\nEND\ngit push"))
        .otherwise(text("(cd /tmp; cat t) ; cat ../notes.md; gh pr comment ", k, " -R team/r -b done"))
    )
    calls = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("call"), conversation.alias("conversation"), F.lit("Bash").alias("tool"), F.to_json(F.struct(line.alias("command"))).alias("args"))
    found = extraction.shell_accesses(extraction.identified(calls), ["conversation"], "page_id")
    return found.select(F.col("call").cast("long").alias("call"), "op", "kind", "target")


SHELL_SESSIONS = """
WITH p AS (SELECT page_id AS call, page_id // 4 AS c, page_id % 4 AS k FROM pages),
base AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.c = p.c AND q.k = 0) THEN '/srv/' || c || '/' ELSE '' END AS home,
  EXISTS (SELECT 1 FROM p q WHERE q.c = p.c AND q.k = 0) AND EXISTS (SELECT 1 FROM p q WHERE q.c = p.c AND q.k = 1) AS cloned,
  EXISTS (SELECT 1 FROM p q WHERE q.c = p.c AND q.k = 2) AS moved FROM p)
SELECT call, 'read' AS op, 'repository' AS kind, 'git.example/team/r' || c AS target FROM base WHERE k = 1
UNION ALL SELECT call, 'read', 'file', home || 'notes.md' FROM base WHERE k = 1
UNION ALL SELECT call, 'write', 'file', CASE WHEN home = '' THEN 'out.md' ELSE home || 'repo/out.md' END FROM base WHERE k = 2
UNION ALL SELECT call, 'write', 'repository', 'git.example/team/r' || c FROM base WHERE k = 2 AND cloned
UNION ALL SELECT call, 'read', 'file', '/tmp/t' FROM base WHERE k = 3
UNION ALL SELECT call, 'read', 'file', CASE WHEN home = '' THEN '../notes.md' WHEN moved THEN home || 'notes.md' ELSE '/srv/notes.md' END FROM base WHERE k = 3
UNION ALL SELECT call, 'write', 'url', 'https://github.com/team/r/issues/' || call FROM base WHERE k = 3"""


def stream_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns sent as server-sent events in pieces of seven characters, and put together again
    with their usage."""
    c = table(spark, sf_dir, "conversations")
    key = F.struct("conv_id", "turn")
    pieces = F.transform(F.sequence(F.lit(0), F.length("text") - 1, F.lit(7)), lambda i: F.substring(F.col("text"), i + 1, F.lit(7)))
    event = lambda name, data: F.concat(F.lit(f"event: {name}\r\ndata: "), data, F.lit("\r\n\r\n"))
    usage = lambda **v: F.to_json(F.struct(*[x.alias(n) for n, x in v.items()]))
    body = F.concat(
        event("start", usage(input_tokens=F.col("turn") + 3, cache_read_input_tokens=F.lit(2), output_tokens=F.lit(1))),
        F.array_join(F.transform(pieces, lambda s: event("delta", F.to_json(F.struct(s.alias("text"))))), ""),
        event("end", usage(output_tokens=F.size(pieces))),
    )
    events = exchanges.sse_events(c.where("length(text) > 0").select(key.alias("key"), body.alias("body")), "key", "body")
    deltas = events.where("event = 'delta'").withColumn("text", F.get_json_object("data", "$.text"))
    texts = exchanges.reassembled(deltas, ["key"], "seq", "text")
    counts = exchanges.merged_usage(events.where("event <> 'delta'"), "key", "seq", "data")
    return texts.join(counts, "key").select("key.conv_id", "key.turn", F.md5("text").alias("text_md5"), "input", "output")


STREAM_REASSEMBLY = """
SELECT conv_id, turn, md5(text) AS text_md5, turn + 5 AS input, ((length(text) + 6) // 7)::BIGINT AS output FROM conversations WHERE length(text) > 0"""


NAMES = (
    "live_hits", "own_replays", "forward_direct_reads", "inherited_fragments", "reader_outputs", "tool_accesses", "shell_sessions", "stream_reassembly",
)
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES}
