"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays together. Groups, largest
first, go to the least-loaded shard, which a heap yields.

Groups of one size are interchangeable, so the schedule is made from the counts of
sizes: exactly that of the single groups, but only as long as there are different
sizes. D of them hold at least D * D / 2 bytes, so T bytes have at most sqrt(2 T)
(14 million at 100 TB, if every size occurred). Of many groups of one size, the
shares of the shards are computed at once: they go where the loads plus multiples
of the size are smallest. One task streams the sizes past the heap and writes a row
for each: up to which rank its groups go to which shard. Groups find their shard by
their rank in that row, by one join. The law held is
``bytes``: loads differ by about the smallest groups, unless a single group is
larger than a shard's share.

Edge cases: a null text counts as empty (size 8, checksum 0) and shares the group
of empty texts; repeated rows are documents of their own in one group; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, materialise, small_side, text_or_empty

SHARDS = 24
#: Groups of one size are numbered in blocks of so many.
BLOCK = 1_000
#: The schedule is broadcast up to so many different sizes, some 20 MB.
BROADCAST_SIZES = 100_000
#: A group that holds a larger share of all rows than one in so many meets its shard by broadcast.
HOT_SHARE = 10_000


def level(loads: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` groups of one size each shard takes when each goes to the least-loaded, ties by number."""

    def below(value: int) -> list[int]:
        return [max(0, -((x - value) // size)) for x in loads]

    # The groups land on the n smallest of all load + m * size: find the value up to which they do.
    low, high = min(loads), max(loads) + n * size
    while low < high:
        middle = (low + high + 1) // 2
        if sum(below(middle)) <= n:
            low = middle
        else:
            high = middle - 1
    out = below(low)
    rest = n - sum(out)
    for s, x in enumerate(loads):
        if rest and x <= low and (low - x) % size == 0:
            out[s] += 1
            rest -= 1
    return out


def placements(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, list[int]]]:
    """``(size, groups, how many of them each shard takes)``, for sizes that come largest first. Holds the heap alone."""
    heap = [(0, s) for s in range(shards)]
    for size, n in sizes:
        if n <= 2 * shards:
            taken = [0] * shards
            for _ in range(n):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                taken[s] += 1
        else:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            taken = level(loads, size, n)
            heap = [(load + k * size, s) for s, (load, k) in enumerate(zip(loads, taken, strict=True))]
            heapq.heapify(heap)
        yield size, n, taken


def scheduled(counts: DataFrame, shards: int) -> DataFrame:
    """``(bytes, n, ends)`` of the histogram ``(bytes, n)``: shard s takes the groups of a size with ranks from ``ends[s - 1]`` up to ``ends[s]``.

    One task streams the histogram past the heap, since each step needs the one before; it
    holds neither the histogram nor the schedule, and neither comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sizes() -> Iterator[tuple[int, int]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        placed = placements(sizes(), shards)
        while part := list(itertools.islice(placed, 10_000)):
            columns = [pa.array([size for size, _, _ in part], pa.int64()), pa.array([n for _, n, _ in part], pa.int64())]
            ends = pa.array([list(itertools.accumulate(taken)) for _, _, taken in part], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, ends], ["bytes", "n", "ends"])

    ordered = counts.select("bytes", "n").repartition(1).sortWithinPartitions(F.desc("bytes"))
    return ordered.mapInArrow(run, "bytes long, n long, ends array<long>")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    text = text_or_empty()
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("gkey"),
        ),
        "sizes",
    )
    groups = materialise(rows.groupBy("gkey").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    counts = groups.groupBy("bytes").agg(F.count("*").alias("n"))
    plan = materialise(scheduled(counts, shards).withColumn("_nb", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "schedule")
    if plan.count() <= BROADCAST_SIZES:
        met = groups.join(F.broadcast(plan), "bytes")
    else:
        # Sizes with many groups are few, and meet their groups by broadcast.
        common = small_side(plan.filter(F.col("_nb") > 100).withColumn("_common", F.lit(True)), BROADCAST_SIZES)
        split = groups.join(common, "bytes", "left")
        met = split.filter("_common").drop("_common").unionByName(split.filter("_common is null").select(*groups.columns).join(plan, "bytes"))
    ranked = gapless_rank(met, "bytes", ["gkey"], None, "rank")
    at = F.size(F.filter("ends", lambda end: end <= F.col("rank")))
    placed = materialise(ranked.select("gkey", "n", at.cast("int").alias("shard")), "placed")
    most = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_SHARE
    # At most HOT_SHARE groups are hot; the others have few rows each.
    hot = F.broadcast(placed.filter(F.col("n") > most).filter(F.col("n") > 1000).select("gkey", F.col("shard").alias("_hot")))
    others = placed.filter((F.col("n") <= most) | (F.col("n") <= 1000)).select("gkey", "shard")
    own = rows.join(hot, "gkey", "left")
    kinds = ["doc_id", "size", "text_crc32", "shard"]
    dealt = own.filter("_hot is not null").withColumnRenamed("_hot", "shard").select(kinds)
    dealt = dealt.unionByName(own.filter("_hot is null").join(small_side(others, 100_000), "gkey").select(kinds))
    per_shard = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    numbered = gapless_rank(dealt, "shard", ["doc_id", "text_crc32"], per_shard or {0: 0}, "slot")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
