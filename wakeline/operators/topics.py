"""Topics: fitting, assignment, sizes, terms, lineage, and the two-dimensional layout."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.vectors import centroids, cosine, unit

FLOOR = 0.5
# English stop words of the term ranking.
STOP = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they "
    "this to was we were which will with you".split()
)
#: Centroids sent to every task; a fit never makes more.
MAX_TOPICS = 10_000


def fit(rows: DataFrame, k: int, seed: int = 0, least: int = 10, floor: float = FLOOR) -> tuple[DataFrame, DataFrame]:
    """Topics of unit vectors (id, vector): centroids (topic, centroid) and members.

    Spherical k-means with members below `floor` similarity left as outliers (topic null).
    Topics are numbered by size, largest first, ties by least member.
    """
    if k > MAX_TOPICS:
        raise ValueError(f"at most {MAX_TOPICS} topics")
    data = rows.select("id", unit("vector").alias("vector")).where("vector IS NOT NULL")
    if data.limit(least).count() < least:
        raise ValueError("too few vectors to fit")
    model = KMeans(k=k, seed=seed, featuresCol="x", predictionCol="c", distanceMeasure="cosine").fit(
        data.withColumn("x", array_to_vector("vector"))
    )
    found = model.transform(data.withColumn("x", array_to_vector("vector"))).select("id", "vector", "c")
    size = found.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    # One row per topic.
    named = size.withColumn("topic", F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).select("c", "topic")
    members = found.join(F.broadcast(named), "c").drop("c")
    middle = centroids(members, "topic", "vector")
    return middle, assign(members.select("id", "vector"), middle, floor)


def few(topics: DataFrame) -> DataFrame:
    """Topics that may go to every task: counted, and refused beyond the bound."""
    if not topics.isStreaming and topics.limit(MAX_TOPICS + 1).count() > MAX_TOPICS:
        raise ValueError(f"at most {MAX_TOPICS} topics")
    return topics


def assign(rows: DataFrame, topics: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(id, topic, similarity): the nearest centroid, ties to the least topic; null below the floor."""
    # One row of all centroids, at most MAX_TOPICS: the best is found within each row, without a shuffle.
    known = few(topics).agg(F.collect_list(F.struct("topic", "centroid")).alias("_t"))
    near = F.transform("_t", lambda t: F.struct(cosine(F.col("vector"), t["centroid"]).alias("similarity"), (-t["topic"]).alias("back")))
    best = rows.crossJoin(F.broadcast(known)).select("id", F.array_max(near).alias("b")).where("b IS NOT NULL")
    return best.select("id", F.when(F.col("b.similarity") >= floor, -F.col("b.back")).alias("topic"), "b.similarity")


def sizes(topics: DataFrame, assigned: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """Every topic once with its sums, zero where it has none; outliers have topic null."""
    summed = assigned.groupBy("topic").agg(*[v.alias(k) for k, v in stats.items()])
    known = topics.select("topic").join(summed.where("topic IS NOT NULL"), "topic", "left").fillna(0, list(stats))
    return known.unionByName(summed.where("topic IS NULL"))


def lineage(old: DataFrame, new: DataFrame, floor: float = FLOOR, others: int = 5) -> DataFrame:
    """For each new topic its old ones by similarity: rank 1 always, others if at the floor.

    Both sides are centroids of one version, at most MAX_TOPICS, so the smaller goes to every task.
    """
    o = few(old).select(F.col("topic").alias("old"), F.col("centroid").alias("_o"))
    pairs = new.select(F.col("topic").alias("new"), "centroid").crossJoin(F.broadcast(o)).select("new", "old", cosine("centroid", "_o").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("new").orderBy(F.desc("similarity"), "old"))
    return pairs.withColumn("rank", rank).where((F.col("rank") == 1) | ((F.col("similarity") >= floor) & (F.col("rank") <= others)))


def remapped(rules: DataFrame, line: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Rules on old topics moved to the new topic most like theirs, or marked stale."""
    best = line.groupBy("old").agg(F.max_by(F.struct("new", "similarity"), F.struct("similarity", -F.col("new"))).alias("b"))
    joined = rules.join(best.select(F.col("old").alias("topic"), F.col("b.new").alias("new_topic"), "b.similarity"), "topic", "left")
    keep = F.coalesce(F.col("similarity") >= floor, F.lit(False))
    return joined.select("rule", "topic", F.when(keep, F.col("new_topic")).alias("new_topic"), (~keep).alias("stale"))


def terms(rows: DataFrame, key: str, text: str, most: int = 10, word: str = r"[\p{L}\p{N}_]{2,}", stop=STOP) -> DataFrame:
    """Terms of each class by class-based TF-IDF: (key, term, weight, rank).

    tf is a term's share of its class's words, idf ln(1 + A / f) with A the mean words of
    a class and f the term's count over all classes. Counts are aggregated before any
    ranking, and rankings only see terms of one class.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(word), F.lit(0))
    n = rows.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    n = n.where(~F.col("term").isin(sorted(stop)))
    size = n.groupBy(key).agg(F.sum("n").alias("size"))
    all_ = n.groupBy("term").agg(F.sum("n").alias("f"))
    mean = size.agg(F.avg("size").alias("mean"))
    weight = F.col("n") / F.col("size") * F.log(1 + F.col("mean") / F.col("f"))
    weighed = n.join(size, key).join(all_, "term").crossJoin(F.broadcast(mean)).select(key, "term", weight.alias("weight"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term"))
    return weighed.where("weight > 0").withColumn("rank", rank).where(F.col("rank") <= most)


def labels(ranked: DataFrame, key: str) -> DataFrame:
    """The first three terms of each class, joined."""
    top = ranked.where("rank <= 3").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return top.select(key, F.array_join(F.transform("t", lambda x: x["term"]), ", ").alias("label"))


def layout(rows: DataFrame) -> DataFrame:
    """(id, x, y): the plane of greatest variance."""
    data = rows.select("id", array_to_vector(F.transform("vector", lambda v: v.cast("double"))).alias("v"))
    plane = PCA(k=2, inputCol="v", outputCol="p").fit(data).transform(data)
    xy = vector_to_array("p")
    return plane.select("id", xy[0].alias("x"), xy[1].alias("y"))


def ready(processed: DataFrame, wanted: int) -> bool:
    """Whether every re-classification of a fit is done, so that it may be activated."""
    return processed.count() >= wanted


#: What a version is after each action of its log.
AFTER = {"begin": "fitting", "complete": "ready", "fail": "failed", "activate": "active", "drop": "dropped"}


def version_states(log: DataFrame) -> DataFrame:
    """The catalogue of topic versions from its log of actions (version, action, at, id):
    (version, state, since). What was done last counts, ties by id; of all versions that are
    active only the one activated last is, and the others are superseded.
    """
    state = F.element_at(F.create_map(*[F.lit(x) for pair in AFTER.items() for x in pair]), F.col("action"))
    rows = log.select("version", state.alias("state"), "at", "id")
    last = rows.groupBy("version").agg(F.max_by(F.struct("state", "at", "id"), F.struct("at", "id")).alias("s")).select("version", "s.*")
    newest = last.where("state = 'active'").agg(F.max_by("version", F.struct("at", "id")).alias("_newest"))
    told = F.when((F.col("state") == "active") & (F.col("version") != F.col("_newest")), "superseded").otherwise(F.col("state"))
    return last.crossJoin(F.broadcast(newest)).select("version", told.alias("state"), F.col("at").alias("since"))
