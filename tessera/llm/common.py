"""Small helpers that every operator of this subpackage uses."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: White space as the contracts define it, inside a regex class.
WS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset (local tests) a
    temporary folder is made and set as the session's checkpoint folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: Paths of intermediate tables that this driver has written and not deleted.
_WRITTEN: dict[str, None] = {}


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder; what was written, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = None
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage and survives the loss of executors: later jobs read files, not
    blocks that one executor holds.
    """
    return written(df, tag)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.pop(path, None)


def intermediate() -> set[str]:
    """The intermediate tables there are now; see ``sweep``."""
    return set(_WRITTEN)


def sweep(spark: SparkSession, before: set[str]) -> None:
    """Delete the intermediate tables written since ``before``, once what was made from them is stored."""
    for path in [p for p in _WRITTEN if p not in before]:
        discard(spark, path)


def small_side(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (counted), else as it is, for a shuffled join.

    For rows of a few numbers the default is some 50 MB on an executor.
    """
    return F.broadcast(df) if df.count() <= rows else df


def gapless_rank(
    df: DataFrame, key: str, order: Sequence[str], counts: dict[int, int] | None, out: str, rows: int = 1000
) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... within each ``key``, without one task per key.

    ``counts`` has the rows of each key (a bounded number of keys, known on the
    driver; sent to all executors up to a million). Each key is cut into as many hash buckets as it has blocks of
    ``rows`` rows; rows are numbered inside a bucket and shifted by the number of
    rows in the buckets before it, so a hot key is spread over many tasks. Without
    ``counts`` the rows bring their key's number of buckets as ``_nb``.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType
    if counts is not None:
        buckets = spark.createDataFrame(
            [(k, max(1, math.ceil(n / rows))) for k, n in counts.items()], f"{key} {kind.simpleString()}, _nb int"
        )
        df = df.join(F.broadcast(buckets) if len(counts) <= 1_000_000 else buckets, key)
    dealt = df.withColumn(
        "_bucket", F.pmod(F.xxhash64(*order, F.lit(7)), F.col("_nb")).cast("int")
    ).drop("_nb")
    ahead = (
        dealt.groupBy(key, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_ahead",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    own = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)).cast("long") - 1
    return (
        dealt.withColumn("_own", own)
        .join(ahead, [key, "_bucket"])
        .withColumn(out, F.col("_own") + F.col("_ahead"))
        .drop("_own", "_ahead", "_bucket")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components: ``(node, root)`` for each node that has an edge.

    Alternates the large-star and small-star steps: every node points at the
    smallest node it knows, until nothing changes. Minima are partly aggregated
    before the shuffle, so a node with very many links is no bottleneck, and each
    round is written to the shared folder.
    """

    def fingerprint(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    def smallest(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.min("v").alias("m"))

    links, path = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u <> v and u is not null and v is not null")
        .distinct(),
        "links",
    )
    seen = fingerprint(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = smallest(large)
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before = path
        links, path = written(small, "links")
        discard(edges.sparkSession, before)
        now = fingerprint(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


_HELD: dict[str, object] = {}


def give_back() -> None:
    """Return freed memory to the system: workers live on, and many small objects leave it in pieces."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held(key: str, make: Callable[[], object]) -> object:
    """A Python worker's cache across tasks. It holds one thing: asking for another drops the one before."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drop what ``held`` keeps, where a stage starts that has no cache."""
    if _HELD:
        _HELD.clear()
        give_back()


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def single_spaces(text: str | Column) -> Column:
    """Each run of white space as one space."""
    # One class test for most characters; a space alone stays as it is.
    return F.regexp_replace(text, r"[\x20\x09-\x0D](?:(?<=[\x09-\x0D])[\x20\x09-\x0D]*+|[\x20\x09-\x0D]++)", " ")


def word_grams(words: str, size: int) -> Column:
    """Every stretch of ``size`` words of a text whose words are parted by single spaces, by its first word."""
    more = rf"(?: [^ ]++){{{size - 1}}}" if size > 1 else ""
    return F.regexp_extract_all(words, F.lit(f"(?=([^ ]++{more}))[^ ]++"), F.lit(1))
