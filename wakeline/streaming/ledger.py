"""Batches of a stream kept exactly once: bucket sums with refusals, and a numbered change feed.

A batch writes folders of its own, named by its number, and then its line in the ledger.
Readers take only batches with a line, and a batch that is tried again after a failure
overwrites its folders with the same rows: all that it depends on is the ledger of the batches
before it. Both stores are sinks for `foreachBatch`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.sources.storage import make_folder, remove, staged

INDEX_BITS = 33


class Ledger:
    """Lines of committed batches under a folder; a line is a row of `FIELDS`."""

    FIELDS = ""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        make_folder(spark, f"{path}/ledger")

    def lines(self) -> DataFrame:
        return self.spark.read.schema(f"{self.FIELDS}, batch long").option("basePath", f"{self.path}/ledger").parquet(f"{self.path}/ledger")

    def _commit(self, batch: int, *fields) -> None:
        self.spark.createDataFrame([fields], self.FIELDS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{kind}/batch={batch}")

    def _read(self, kind: str, schema: str, lines: DataFrame) -> DataFrame:
        """Rows of the batches in lines. There is one line a batch."""
        make_folder(self.spark, f"{self.path}/{kind}")
        rows = self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")
        return rows.join(F.broadcast(lines.select("batch")), "batch", "left_semi")

    def sink(self, batch: DataFrame, number: int) -> None:
        """For `writeStream.foreachBatch`."""
        self.apply(batch, number)

    def apply(self, batch: DataFrame, number: int) -> None:
        raise NotImplementedError


class BucketSums(Ledger):
    """Sums by tumbling bucket and key; rows whose bucket was closed are refused and kept aside.

    A bucket is closed once the latest time of earlier batches has passed its end by `delay`
    (both in microseconds). `compact` folds the committed batches into one base.
    """

    FIELDS = "mark long, base boolean"

    def __init__(self, spark: SparkSession, path: str, at: str, width: int, delay: int, keys: list[str], values: list[str], schema: str):
        """schema: of the batches' rows, from which those of sums and refusals follow."""
        super().__init__(spark, path)
        self.at, self.width, self.delay, self.keys, self.values, self.schema = at, width, delay, keys, values, schema
        kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
        self.sums_schema = ", ".join(["bucket long", *(f"`{k}` {kinds[k]}" for k in keys), *(f"`{v}` {'double' if kinds[v] in ('double', 'float') else 'long'}" for v in values)])

    def mark(self, before: int) -> int | None:
        """The latest time of the lines before one."""
        return self.lines().where(F.col("batch") < before).agg(F.max("mark")).first()[0]

    def apply(self, batch: DataFrame, number: int) -> None:
        # Batches have the even numbers, and a base the odd one after its last batch.
        number *= 2
        mark = self.mark(number)
        rows = batch.withColumn("bucket", F.col(self.at) - F.pmod(F.col(self.at), F.lit(self.width)))
        late = F.lit(False) if mark is None else F.col("bucket") + self.width <= F.lit(mark - self.delay)
        held, path = staged(rows.withColumn("_late", F.coalesce(late, F.lit(False))), "batch")
        kept = held.where(~F.col("_late")).groupBy("bucket", *self.keys).agg(*[F.sum(v).alias(v) for v in self.values])
        self._write(kept, "sums", number)
        self._write(held.where("_late").drop("_late", "bucket"), "refused", number)
        newest = held.agg(F.max(self.at)).first()[0]
        self._commit(number, max((x for x in (mark, newest) if x is not None), default=None), False)
        remove(self.spark, path)

    def _current(self) -> DataFrame:
        """Lines from the last base on."""
        lines = self.lines()
        return lines.where(F.col("batch") >= (lines.where("base").agg(F.max("batch")).first()[0] or 0))

    def read(self) -> DataFrame:
        rows = self._read("sums", self.sums_schema, self._current())
        return rows.groupBy("bucket", *self.keys).agg(*[F.sum(v).alias(v) for v in self.values])

    def refused(self) -> DataFrame:
        return self._read("refused", self.schema, self.lines()).drop("batch")

    def compact(self) -> None:
        """Fold what is committed into a base, which takes effect with its line."""
        last = self.lines().orderBy(F.desc("batch")).first()
        # After a base only batches may follow, whose numbers are even.
        if last is None or last["base"]:
            return
        held, path = staged(self.read(), "base")
        self._write(held, "sums", last["batch"] + 1)
        self._commit(last["batch"] + 1, last["mark"], True)
        remove(self.spark, path)


class ChangeFeed(Ledger):
    """Changes numbered from 1 without gaps, in order of batch and of `order` within a batch.

    A reader holds a cursor, the number of the last change it has. `drop` forgets old batches;
    a cursor older than what is kept must read the whole state anew (`resync`).
    """

    FIELDS = "first long, last long"

    def __init__(self, spark: SparkSession, path: str, order: list[str], schema: str):
        super().__init__(spark, path)
        self.order, self.schema = order, schema

    def last(self, before: int | None = None) -> int:
        lines = self.lines() if before is None else self.lines().where(F.col("batch") < before)
        return lines.agg(F.max("last")).first()[0] or 0

    def apply(self, batch: DataFrame, number: int) -> None:
        start = self.last(number)
        names = batch.columns
        # Rows of one range partition follow each other; a partition's rows number from what those before it hold.
        dealt = batch.repartitionByRange(*self.order).sortWithinPartitions(*self.order, *names).withColumn("_m", F.monotonically_increasing_id())
        held, path = staged(dealt, "changes")
        part = F.shiftright("_m", INDEX_BITS)
        sizes = held.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
        before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
        index = F.col("_m").bitwiseAND(F.lit((1 << INDEX_BITS) - 1))
        # A row a partition.
        seq = held.join(F.broadcast(before), part == F.col("_p")).withColumn("seq", index + F.col("_before") + start + 1)
        self._write(seq.select("seq", *names), "changes", number)
        self._commit(number, start + 1, start + held.count())
        remove(self.spark, path)

    def resync(self, cursor: int) -> bool:
        """Whether changes after a cursor are no longer all here."""
        kept = self.lines().where("last >= first").agg(F.min("first")).first()[0]
        return cursor < self.last() and (kept is None or cursor + 1 < kept)

    def after(self, cursor: int, most: int | None = None) -> DataFrame:
        """Changes after a cursor in order, at most so many; only batches that reach past it are read."""
        if self.resync(cursor):
            raise LookupError(f"changes after {cursor} are gone: read the state anew and go on from {self.last()}")
        stop = F.lit(True) if most is None else F.col("seq") <= cursor + most
        lines = self.lines().where(F.col("last") > cursor)
        return self._read("changes", f"seq long, {self.schema}", lines).where((F.col("seq") > cursor) & stop).drop("batch").orderBy("seq")

    def drop(self, up_to: int) -> None:
        """Forget the changes of batches that end at a number or before it; their lines stay, emptied."""
        for line in self.lines().where((F.col("last") <= up_to) & (F.col("last") >= F.col("first"))).collect():
            self._commit(line["batch"], line["last"] + 1, line["last"])
            remove(self.spark, f"{self.path}/changes/batch={line['batch']}")
