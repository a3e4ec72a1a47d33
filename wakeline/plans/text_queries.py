"""Text, provenance, search, topics, locators and decoding on the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import decode, text, urls, vectors
from wakeline.operators import density, layouts, paging, provenance, search, topics
from wakeline.sources.storage import checkpoint, new_path, table

GRAM = provenance.GRAM


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    n = text.normalize("text")
    return d.select("doc_id", F.md5(n).alias("normal"), F.length(n).alias("length"), text.trimmed_length("text").alias("trimmed"))


TEXT_NORMALIZE = r"""
SELECT doc_id, md5(regexp_replace(lower(text), '\s+', ' ', 'g')) AS normal, length(regexp_replace(lower(text), '\s+', ' ', 'g'))::INT AS length,
  length(regexp_replace(text, '^\s+|\s+$', '', 'g'))::INT AS trimmed FROM documents"""


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(text.tokens("text")).alias("tokens"), F.size(text.lexemes("text")).alias("lexemes"), text.snippet("text").alias("snippet"))


TEXT_TOKENS = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda t: length(t) >= 4 OR regexp_matches(t, '\p{N}')))::INT AS tokens,
  len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')))::INT AS lexemes, left(text, 160) AS snippet FROM documents"""


def shingle_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams of benchmark items by the number of documents that hold them."""
    held = provenance.shared_grams(_docs(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")
    return provenance.document_frequency(held, "doc_id")


GRAMS = f"""
d AS (SELECT doc_id, i - 1 AS pos, cast('0x' || substr(md5(substr(text, i, {GRAM})), 1, 15) AS BIGINT) AS fp
      FROM (SELECT doc_id, text, unnest(range(1, length(text) - {GRAM} + 2)) AS i FROM documents)),
b AS (SELECT item_id, i - 1 AS pos, cast('0x' || substr(md5(substr(text, i, {GRAM})), 1, 15) AS BIGINT) AS fp
      FROM (SELECT item_id, text, unnest(range(1, length(text) - {GRAM} + 2)) AS i FROM benchmark))
"""
SHINGLE_DF = f"WITH {GRAMS} SELECT fp, count(DISTINCT doc_id) AS texts FROM d WHERE fp IN (SELECT fp FROM b) GROUP BY fp"


def winnow_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.winnowed(_docs(spark, sf_dir), "doc_id", "text", portable=True).withColumn("pos", F.col("pos").cast("long"))


WINNOW_FINGERPRINTS = f"""
WITH {GRAMS}, n AS (SELECT doc_id, max(pos) + 1 AS n FROM d GROUP BY 1),
w AS (SELECT doc_id, pos AS at, arg_min(pos, (fp, -pos)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS pos FROM d)
SELECT DISTINCT d.doc_id, d.pos, d.fp FROM w JOIN n USING (doc_id) JOIN d USING (doc_id, pos) WHERE w.at <= greatest(n.n - 16, 0)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = provenance.grams(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "origin")
    held = checkpoint(provenance.shared_grams(_docs(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text").withColumnRenamed("doc_id", "reader"))
    return provenance.matches(items, held, provenance.document_frequency(held, "reader"))


def fingerprint_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("origin", "reader").agg(F.count("*").alias("pairs"))


HITS = f"""
WITH {GRAMS}, held AS (SELECT * FROM d WHERE fp IN (SELECT fp FROM b)),
stop AS (SELECT fp FROM held GROUP BY fp HAVING count(DISTINCT doc_id) > {provenance.CUTOFF}),
hits AS (SELECT b.item_id AS origin, held.doc_id AS reader, b.pos AS origin_pos, held.pos AS reader_pos FROM b JOIN held USING (fp) WHERE fp NOT IN (SELECT fp FROM stop))
"""
FINGERPRINT_MATCHES = HITS + "SELECT origin, reader, count(*) AS pairs FROM hits GROUP BY ALL"


def copied_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.copied_runs(_hits(spark, sf_dir)).select("reader", "origin", F.col("offset").cast("long").alias("offset"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "grams")


COPIED_RUNS = HITS + f"""
, h AS (SELECT DISTINCT reader, origin, reader_pos, reader_pos - origin_pos AS "offset" FROM hits),
i AS (SELECT *, reader_pos - row_number() OVER (PARTITION BY reader, origin, "offset" ORDER BY reader_pos) AS g FROM h)
SELECT reader, origin, "offset", min(reader_pos) AS start, max(reader_pos) + {GRAM} AS "end", count(*) AS grams FROM i GROUP BY reader, origin, "offset", g"""


def copied_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each document covered by copied runs of 64 or more."""
    runs = provenance.long_runs(copied_runs(spark, sf_dir))
    return provenance.covered(provenance.merged_intervals(runs, ["reader"]), ["reader"])


COPIED_EXTENT = f"WITH runs AS ({COPIED_RUNS}), " + """
cells AS (SELECT DISTINCT reader, unnest(range(start, "end")) AS at FROM runs WHERE "end" - start >= 64)
SELECT reader, count(*) AS covered FROM cells GROUP BY reader"""


def copied_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of documents with copied runs that no run covers."""
    merged = provenance.merged_intervals(copied_runs(spark, sf_dir), ["reader"])
    length = _docs(spark, sf_dir).select(F.col("doc_id").alias("reader"), F.length("text").cast("long").alias("length")).join(merged.select("reader").distinct(), "reader", "left_semi")
    return provenance.gaps(merged, ["reader"], length)


COPIED_GAPS = f"WITH runs AS ({COPIED_RUNS}), " + """
own AS (SELECT doc_id AS reader, unnest(range(0, length(text))) AS p FROM documents WHERE doc_id IN (SELECT reader FROM runs)),
free AS (SELECT reader, p FROM own EXCEPT SELECT reader, unnest(range(start, "end")) FROM runs),
i AS (SELECT *, p - row_number() OVER (PARTITION BY reader ORDER BY p) AS g FROM free)
SELECT reader, min(p) AS start, max(p) + 1 AS "end" FROM i GROUP BY reader, g"""


def spread_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints held by four sources or more."""
    d = _docs(spark, sf_dir)
    kept = provenance.winnowed(d.select(F.struct("doc_id", "source").alias("key"), "text"), "key", "text", portable=True)
    return provenance.spread(kept.select("fp", F.col("key.source").alias("agent")))


SPREAD_BOILERPLATE = f"WITH k AS ({WINNOW_FINGERPRINTS}) " + """
SELECT fp, count(DISTINCT source) AS holders FROM k JOIN documents USING (doc_id) GROUP BY fp HAVING count(DISTINCT source) >= 4"""

WORDS = "the hestan thndor nonesuch"


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.by_text(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("body")), WORDS, 50)
    return found.withColumn("score", F.round("score", 9))


TERMS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"
TEXT_SCORE = f"len(list_intersect({TERMS}, ['the', 'hestan', 'thndor', 'nonesuch'])) / 4"
TEXT_SEARCH = f"""
SELECT doc_id AS id, round({TEXT_SCORE}, 9) AS score, left(text, 160) AS snippet FROM documents
WHERE {TEXT_SCORE} > 0 ORDER BY score DESC, id DESC LIMIT 50"""


def _query_vector() -> list[float]:
    n = 64
    return [1.0 / n**0.5 if i % 2 else -1.0 / n**0.5 for i in range(n)]


VECTOR = "[" + ", ".join(f"{v!r}::DOUBLE" for v in _query_vector()) + "]"
COSINE = f"least(1.0, greatest(0.0, list_dot_product(embedding::DOUBLE[], {VECTOR})))"


def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.by_vector(rows, _query_vector(), 50).withColumn("score", F.round("score", 6))


SEMANTIC_SEARCH = f"SELECT vec_id AS id, round({COSINE}, 6) AS score FROM embeddings ORDER BY {COSINE} DESC, id DESC LIMIT 50"


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return search.by_both(d.join(e, "id"), WORDS, _query_vector(), 50).withColumn("score", F.round("score", 6))


HYBRID_SEARCH = f"""
SELECT doc_id AS id, round(({TEXT_SCORE} + {COSINE}) / 2, 6) AS score FROM documents JOIN embeddings ON doc_id = vec_id
ORDER BY ({TEXT_SCORE} + {COSINE}) / 2 DESC, id DESC LIMIT 50"""


def _centroids(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(where)
    return vectors.centroids(e.select(F.col("label").alias("topic"), "embedding"), "topic", "embedding")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centroids(spark, sf_dir).select("topic", F.posexplode("centroid").alias("dim", "v")).withColumn("v", F.round("v", 6))


def _centroid_sql(name: str, where: str) -> str:
    return f"""
{name}_flat AS (SELECT label AS topic, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE {where}),
{name}_mean AS (SELECT topic, dim, avg(v) AS v FROM {name}_flat GROUP BY ALL),
{name} AS (SELECT topic, dim, v / sqrt(sum(v * v) OVER (PARTITION BY topic)) AS v FROM {name}_mean)"""


CENTROIDS = f"WITH {_centroid_sql('c', 'true')} SELECT topic, dim::INT AS dim, round(v, 6) AS v FROM c"


def topic_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return topics.assign(rows, _centroids(spark, sf_dir), 0.1).withColumns({"topic": F.coalesce("topic", F.lit(-1)), "similarity": F.round("similarity", 6)})


ASSIGNED = f"""
WITH {_centroid_sql('c', 'true')}, l AS (SELECT topic, list(v ORDER BY dim) AS centroid FROM c GROUP BY topic),
s AS (SELECT vec_id AS id, topic, least(1.0, greatest(0.0, list_dot_product(embedding::DOUBLE[], centroid))) AS similarity FROM embeddings, l),
a AS (SELECT id, arg_max(topic, (similarity, -topic)) AS topic, max(similarity) AS similarity FROM s GROUP BY id)
"""
TOPIC_ASSIGN = ASSIGNED + "SELECT id, CASE WHEN similarity >= 0.1 THEN topic ELSE -1 END AS topic, round(similarity, 6) AS similarity FROM a"


def topic_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _centroids(spark, sf_dir)
    extra = known.select("topic").unionByName(spark.createDataFrame([(999,)], "topic int"))
    return topics.sizes(extra, topic_assign(spark, sf_dir).withColumn("topic", F.nullif("topic", F.lit(-1))), {"members": F.count("*"), "nearest": F.max("similarity")}).select(F.coalesce("topic", F.lit(-1)).alias("topic"), "members")


TOPIC_SIZES = ASSIGNED + """
, t AS (SELECT CASE WHEN similarity >= 0.1 THEN topic END AS topic FROM a), n AS (SELECT topic, count(*) AS members FROM t GROUP BY topic)
SELECT k.topic, coalesce(members, 0) AS members FROM (SELECT topic FROM l UNION ALL SELECT 999) k LEFT JOIN n USING (topic)
UNION ALL SELECT -1, members FROM n WHERE topic IS NULL"""


def topic_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = topics.lineage(_centroids(spark, sf_dir, "vec_id % 2 = 0"), _centroids(spark, sf_dir, "vec_id % 2 = 1"), 0.2, 3)
    return line.withColumn("similarity", F.round("similarity", 6))


TOPIC_LINEAGE = f"""
WITH {_centroid_sql('o', 'vec_id % 2 = 0')}, {_centroid_sql('n', 'vec_id % 2 = 1')},
s AS (SELECT n.topic AS new, o.topic AS old, least(1.0, greatest(0.0, sum(n.v * o.v))) AS similarity FROM n JOIN o USING (dim) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY new ORDER BY similarity DESC, old)::INT AS rank FROM s)
SELECT new, old, round(similarity, 6) AS similarity, rank FROM r WHERE rank = 1 OR (similarity >= 0.2 AND rank <= 3)"""


def ctfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.terms(_docs(spark, sf_dir), "lang", "text").withColumn("weight", F.round("weight", 9))


STOP = ", ".join(f"'{w}'" for w in sorted(topics.STOP))
CTFIDF_TERMS = rf"""
WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents),
n AS (SELECT lang, term, count(*) AS n FROM w WHERE term NOT IN ({STOP}) GROUP BY ALL),
z AS (SELECT lang, sum(n) AS size FROM n GROUP BY 1), f AS (SELECT term, sum(n) AS f FROM n GROUP BY 1),
x AS (SELECT lang, term, n / size * ln(1 + (SELECT avg(size) FROM z) / f) AS weight FROM n JOIN z USING (lang) JOIN f USING (term))
SELECT lang, term, round(weight, 9) AS weight, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term)::INT AS rank FROM x
QUALIFY rank <= 10"""


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat(F.upper(F.substring("url", 1, 5)), F.substring("url", 6, 1 << 20))
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(u).alias("canonical"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"))


URL_CANONICAL = r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
c AS (SELECT page_id, lower(s) AS s, host, CASE WHEN p = '' THEN '/' ELSE p END AS path,
  CASE WHEN q <> '' THEN array_to_string(list_sort(string_split(q, '&')), '&') END AS query FROM p)
SELECT page_id, s || '://' || host || path || CASE WHEN query IS NULL THEN '' ELSE '?' || query END AS canonical, host, path, query FROM c"""


def resource_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", urls.matches("path_prefix", "/en", F.col("url")).alias("english"), urls.matches("path_prefix", "/en/1", F.col("url")).alias("first"))


RESOURCE_PATTERN = r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)
SELECT page_id, p = '/en' OR p LIKE '/en/%' AS english, p = '/en/1' OR p LIKE '/en/1/%' AS first FROM p"""


ENCODE = {"base64": lambda c: F.regexp_replace(F.base64(F.encode(c, "utf-8")), r"\s", ""), "hex": lambda c: F.hex(F.encode(c, "utf-8")), "url": F.url_encode}
HIDDEN = (("base64",), ("hex",), ("url",), ("base64", "hex"), ("hex", "base64"), ("base64", "url"), ("hex", "url"), ("hex", "base64", "hex"), ("base64", "hex", "url"))


def decode_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items hidden under one to three encodings, and found again under each."""

    def hidden(chain: tuple[str, ...]) -> Column:
        c = F.col("text")
        for name in reversed(chain):
            c = ENCODE[name](c)
        return F.struct(F.lit(">".join(chain)).alias("codec"), F.concat(F.lit("see "), c, F.lit(" there")).alias("text"))

    each = F.explode(F.array(*map(hidden, HIDDEN)))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("plain"), each.alias("h")).select(F.struct("item_id", "h.codec", "plain").alias("key"), "h.text")
    found = decode.layers(rows, "key", "text").where((F.size("chain") > 0) & (F.col("text") == F.col("key.plain")))
    return found.select("key.item_id", "key.codec", F.array_join("chain", ">").alias("found_by"), F.length("text").alias("length"))


def _round_trip(chain: tuple[str, ...]) -> str:
    """SQL that encodes the text along a chain and decodes it again."""
    up = {"base64": "base64(encode({}))", "hex": "hex(encode({}))", "url": "url_encode({})"}
    down = {"base64": "decode(from_base64({}))", "hex": "decode(unhex({}))", "url": "url_decode({})"}
    s = "text"
    for name in reversed(chain):
        s = up[name].format(s)
    for name in chain:
        s = down[name].format(s)
    return s


DECODE_LAYERS = "\nUNION ALL ".join(
    f"SELECT item_id, '{'>'.join(chain)}' AS codec, '{'>'.join(chain)}' AS found_by, length({_round_trip(chain)})::INT AS length FROM benchmark"
    + (" WHERE regexp_matches(text, '[^A-Za-z0-9 .*_-]')" if "url" in chain else "")
    for chain in HIDDEN
)


def unicode_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose Latin letters were replaced by look-alikes, with unseen characters, folded back."""
    hidden = F.regexp_replace(F.translate("text", decode.LATIN[:20], decode.CONFUSABLE[:20]), "(?<=t)(?=h)", "\u200b\u2061")
    return _docs(spark, sf_dir).select("doc_id", F.md5(decode.fold_unicode(hidden)).alias("folded"), (F.md5(hidden) != F.md5("text")).alias("changed"))


UNICODE_FOLD = f"""
SELECT doc_id, md5(translate(text, '{decode.CONFUSABLE}', '{decode.LATIN}')) AS folded,
  regexp_matches(text, '[{decode.LATIN[:20]}]') OR contains(text, 'th') AS changed FROM documents"""


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.seeded_sample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "seed-1", 40)


SEEDED_SAMPLE = """
SELECT vec_id, label, count(*) OVER () AS matching FROM embeddings ORDER BY md5('seed-1|' || vec_id), vec_id LIMIT 40"""


def export_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export of the suppliers in key order, and its rows read again from the files: the place of each
    is the rows of the files before its own, and of those before it there."""
    from wakeline.sources import logs

    path = new_path(spark, "export")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    trailer = logs.export(rows, "agents", path, ["s_suppkey"])
    if logs.seal(spark, path) | {"complete": True} != trailer:
        raise ValueError("the export is not what its trailer says")
    lines = spark.read.text(f"{path}/rows", wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    each = lines.select("file", F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("i", "line")).where("line <> ''")
    # A row a file.
    sizes = each.groupBy("file").agg(F.count("*").alias("n")).withColumn("before", F.expr("sum(n) OVER (ORDER BY file) - n"))
    row = F.from_json("line", rows.schema).alias("r")
    return each.join(F.broadcast(sizes), "file").select((F.col("before") + F.col("i")).alias("place"), row).select("place", "r.*")


EXPORT_DIGEST = "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS place, s_suppkey, s_name, s_nationkey FROM supplier"


def topic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return topics.fit(rows, 8, seed=7)[1]


def topic_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of the vectors, topic null for outliers."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return density.fit(rows)[1]


def layout_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame laid out from every second vector, and the others placed in it."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    frame = layouts.fit(rows.where("id % 2 = 0"))
    return frame.select("id", "x", "y").unionByName(layouts.place(rows.where("id % 2 = 1"), frame))


def projection_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.layout(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type through a stream; the buckets that its watermark has closed."""
    import uuid

    from wakeline.streaming import buckets

    stream = buckets.read_table(spark, f"{sf_dir}/events.parquet", "ts")
    sums = buckets.tumbling(stream, "ts", "1 day", ["event_type"], "10 minutes", events=F.count("*"))
    return buckets.run_once(sums, f"wakeline_{uuid.uuid4().hex}", new_path(spark, "stream"))


STREAM_BUCKETS = """
WITH b AS (SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, event_type, count(*) AS events FROM events GROUP BY 1, 2)
SELECT * FROM b WHERE bucket + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"""


NAMES = (
    "text_normalize", "text_tokens", "shingle_df", "winnow_fingerprints", "fingerprint_matches", "copied_runs",
    "copied_extent", "copied_gaps", "spread_boilerplate", "text_search", "semantic_search", "hybrid_search", "centroids",
    "topic_assign", "topic_sizes", "topic_lineage", "ctfidf_terms", "url_canonical", "resource_pattern", "decode_layers", "unicode_fold",
    "seeded_sample", "export_digest", "stream_buckets",
)
QUERIES = {n: globals()[n] for n in (*NAMES, "topic_fit", "topic_density", "projection_2d", "layout_placed")}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES}
