"""Writes: appends with ordered ids, dual writes, text and row sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.messages import newest
from .shared import stored


def with_ids(df: DataFrame, order: Sequence[str], last_id: int, path: str, buckets: int = 64) -> DataFrame:
    """Gapless ids after ``last_id`` in the order given.

    Rows are cut into ranges by the order; numbers start in each range behind the
    rows of the ranges before it, so no task sees all rows. The ranges are written
    to ``path`` once (a folder that all executors share, the caller's to delete):
    planned twice, each plan would sample bounds of its own, and the counts would
    not be those of the ranges numbered.
    """
    dealt = df.repartitionByRange(buckets, *order).withColumn("_p", F.spark_partition_id())
    dealt.write.mode("overwrite").parquet(path)
    ranged = df.sparkSession.read.schema(dealt.schema).parquet(path)
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    ranged = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)).cast("long"))
    # One row per range: at most ``buckets``.
    ahead = counts.withColumn(
        "_a", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_p", "_a")
    return ranged.join(F.broadcast(ahead), "_p").withColumn("id", F.lit(last_id) + F.col("_a") + F.col("_r")).drop("_p", "_r", "_a", "_n")


def append_messages(df: DataFrame, path: str) -> None:
    """System rows are never stored."""
    df.filter("role <> 'system'").write.mode("append").parquet(path)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def dual_sink(*writers: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: every writer gets the batch, which is computed once; a writer's failure fails the batch."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for w in writers:
                w(batch)
        finally:
            batch.unpersist()

    return write


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A writer that can be repeated: a batch is the partition of its number, which a second try replaces."""

    def write(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("_batch", F.lit(number).cast("long"))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)

    return write


class Ledger:
    """Which writers have finished which batch: an empty file for each, in a folder that survives the driver.

    A stream repeats its last batch only, so marks of the batches before are dropped when a new one is done.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.folder = spark._jvm.org.apache.hadoop.fs.Path, path.rstrip("/")
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, number: int, writer: str = ""):
        return self.path(f"{self.folder}/{number}/{writer}".rstrip("/"))

    def finished(self, number: int, writer: str) -> bool:
        return self.fs.exists(self._of(number, writer))

    def finish(self, number: int, writer: str) -> None:
        self.fs.create(self._of(number, writer), True).close()

    def forget_before(self, number: int) -> None:
        self.fs.delete(self._of(number - 1), True)


def ledger_sink(ledger: str, **writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each writer takes each batch once, in the order given.

    A writer's failure fails the batch; when it is tried again, the writers that finished it
    are left out. Between a write and its mark a driver may be lost, so writers have to be
    repeatable (``batch_writer``, or an upsert by key).
    """

    def write(batch: DataFrame, number: int) -> None:
        marks = Ledger(batch.sparkSession, ledger)
        batch.persist()
        try:
            for name, w in writers.items():
                if not marks.finished(number, name):
                    w(batch, number)
                    marks.finish(number, name)
            marks.forget_before(number)
        finally:
            batch.unpersist()

    return write


def retention_writer(path: str, keys: Sequence[str], order: str, keep: int, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """A writer that keeps the ``keep`` newest rows of each session, reading and writing only what a batch touches.

    Sessions are dealt to ``buckets`` partitions by their hash. The partitions of a batch's
    sessions are read, merged with it and replaced; all other files stay as they are. A
    repeated batch changes nothing, since rows of one session and order are one row.
    """

    def write(batch: DataFrame, _: int = 0) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets``
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            held = spark.read.schema(rows.schema).parquet(path).filter(F.col("_bucket").isin(touched))
            rows = held.unionByName(rows).dropDuplicates([*keys, order])
        kept = newest(rows, [*keys], order, keep)
        # A batch writes its partitions whole, one file each.
        kept.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)

    return write


def routed_only(df: DataFrame, context: str = "ctx_bot_id", bot: str = "bot_id") -> DataFrame:
    """Outbound rows whose context belongs to the sending bot."""
    return df.filter(F.col(context) == F.col(bot))


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def cache_put(cache: DataFrame, writes: DataFrame) -> DataFrame:
    """The cache ``(key, value, written_at)`` after a batch of writes: the latest write of each key, whose time to live starts anew."""
    both = cache.select("key", "value", "written_at").unionByName(writes.select("key", "value", "written_at"))
    return both.groupBy("key").agg(F.max_by("value", "written_at").alias("value"), F.max("written_at").alias("written_at"))


def cache_live(cache: DataFrame, now, ttl_minutes: int = 30) -> DataFrame:
    """Entries that a read at ``now`` (a column or a value) still finds; reads do not prolong them."""
    age = F.timestamp_diff("SECOND", "written_at", now if isinstance(now, Column) else F.lit(now))
    return cache.filter(age < 60 * ttl_minutes)


def cache_reads(writes: DataFrame, reads: DataFrame, ttl_minutes: int = 30) -> DataFrame:
    """``(key, read_at, hit, value)``: what each of ``reads (key, read_at)`` finds of ``writes (key, value, written_at)``.

    The latest write up to a read answers it, if its time to live is not over. Rows are sorted
    into ranges of (key, time), so that a hot key is no single task; what a range begins with
    is the last write of the ranges before it. Of writes at one moment the greatest value counts.
    """
    entry = F.struct("written_at", "value")
    both = writes.select("key", F.col("written_at").alias("at"), entry.alias("entry")).unionByName(
        reads.select("key", F.col("read_at").alias("at"), F.lit(None).cast(writes.select(entry.alias("e")).schema["e"].dataType).alias("entry"))
    )
    # Writes before reads of the same moment.
    order = [F.asc("at"), F.asc(F.col("entry").isNull()), F.asc("entry.value")]
    ranged = stored(both.repartitionByRange("key", "at").withColumn("_p", F.spark_partition_id()), "reads")
    own = F.last("entry", ignorenulls=True).over(Window.partitionBy("key", "_p").orderBy(*order))
    # A row for each range that a key has.
    newest_write = ranged.filter("entry is not null").groupBy("key", "_p").agg(F.max("entry").alias("_last"))
    parts = ranged.select("key", "_p").distinct().join(newest_write, ["key", "_p"], "left")
    before = Window.partitionBy("key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("key", "_p", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    found = ranged.withColumn("_own", own).filter("entry is null").join(carried, ["key", "_p"], "left")
    found = found.withColumn("_found", F.coalesce("_own", "_carried"))
    live = F.coalesce(F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("_found.written_at").cast("timestamp")) < 60_000_000 * ttl_minutes, F.lit(False))
    return found.select("key", F.col("at").alias("read_at"), live.alias("hit"), F.when(live, F.col("_found.value")).alias("value"))
