"""SimHash near-duplicate detection with deletion-variant signatures.

A fingerprint has 64 bits; two documents link when theirs differ in at most four.
The bits are cut into three segments, so at least one segment differs in at most
one bit. For each bit of each segment one variant is indexed: the segment with
that bit struck out. Two fingerprints whose segment differs in at most one bit
share a variant, so equality finds every link, and each candidate is verified on
all 64 bits. A link is reported only by the first variant its two ends share.

Equal fingerprints are one node. Variants are shuffled by value and sorted, then
read as a stream: small buckets are compared pairwise, large ones are searched
breadth-first, reporting a spanning forest and never all pairs. Buckets beyond
``bucket_limit`` take another exact way: fingerprints within two bits of the
same value are within four of each other, and any linked pair has such a value
between them, so their members are tied to those values without comparisons.

Variants have 21 bits besides the struck one. From ``LONG_KEYS`` different
fingerprints on each is joined by one of five pieces of the remaining bits, one of
which a link leaves whole: five times the rows, and buckets some 300 times smaller.

Edge cases: null and empty texts have fingerprint zero and link like any other;
texts of fewer than four words are one shingle; repeated rows share a
fingerprint; a null ``doc_id`` never is a component's name unless all are null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, release, small_side

WORDS = 4
SEED = 42
DISTANCE = 4
#: First bit and end of each segment.
SEGMENTS = ((0, 22), (22, 43), (43, 64))
#: Where a variant has its struck bit.
_BIT = 40
#: Up to this size buckets are compared pairwise by shifting the sorted column.
PAIRWISE = 16
BUCKET_LIMIT = 8192
#: Different fingerprints from which on the index has longer keys.
LONG_KEYS = 8_000_000
#: First bit and end of each piece of the other segments' bits (moved together), one of which links leave whole.
PIECES = ((0, 9), (9, 18), (18, 26), (26, 34), (34, 42))


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= WORDS:
        h = np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-WORDS])).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter(
            [digest(whole[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist(), strict=True)],
            np.uint64,
            len(starts),
        )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fp long"
    )


def variants(nodes: DataFrame, long_keys: bool = False) -> DataFrame:
    """64 rows for each fingerprint: the struck bit and what is left of its segment, in one number.

    With ``long_keys`` there are five for each of them, each with one piece of the
    other segments: four differing bits leave at least one of five pieces as it is.
    """
    keys = []
    for lo, hi in SEGMENTS:
        segment = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        below = F.col("fp").bitwiseAND(F.lit((1 << lo) - 1))
        others = below.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", hi), lo)) if hi < 64 else below
        tails = [F.lit(0).cast("long")]
        if long_keys:
            tails = [
                F.shiftleft(F.shiftrightunsigned(others, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).bitwiseOR(F.lit((k + 1) << 9).cast("long")), 22)
                for k, (a, b) in enumerate(PIECES)
            ]
        for bit in range(hi - lo):
            left = segment.bitwiseAND(F.lit(~(1 << bit))).bitwiseOR(F.lit((lo + bit) << _BIT))
            keys += [left.bitwiseOR(tail) for tail in tails]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("variant"))


def _first_shared(x: np.ndarray) -> np.ndarray:
    """The first struck bit that two fingerprints of difference ``x`` share."""
    out = np.full(x.shape, -1, np.int64)
    for lo, hi in reversed(SEGMENTS):
        part = (x >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        n = np.bitwise_count(part)
        bit = np.where(n == 0, 0, np.bitwise_count(part - np.uint64(1)))
        out = np.where(n <= 1, lo + bit.astype(np.int64), out)
    return out


def _linked(x: np.ndarray, bit: np.ndarray | int) -> np.ndarray:
    near = np.bitwise_count(x) <= DISTANCE
    if near.any():
        near[near] = _first_shared(x[near]) == (bit if np.isscalar(bit) else bit[near])
    return near


def _forest(fps: np.ndarray, bit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the bucket's links connect: each node is expanded once."""
    rest = fps
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            level = queue.pop()
            for node in level:
                near = _linked(rest ^ node, bit)
                if near.any():
                    found, rest = rest[near], rest[~near]
                    yield np.full(len(found), node), found
                    queue.append(found)
                    if not len(rest):
                        break


def links(nodes: DataFrame, bucket_limit: int = BUCKET_LIMIT, long_keys: bool = False) -> DataFrame:
    """Verified links ``(a, b)`` of different fingerprints that join all components; ``b`` null: ``a`` is in a bucket beyond the limit."""

    def bucket(fps: np.ndarray, key: int, large: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        if large:
            yield fps, fps, True
        else:
            for a, b in _forest(fps, key >> _BIT):
                yield a, b, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_n, held_key, large = 0, None, False

        def out(a: np.ndarray, b: np.ndarray, alone: bool) -> pa.RecordBatch:
            second = pa.nulls(len(a), pa.int64()) if alone else pa.array(b.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)), second], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(cuts, len(key)))
            first_end, last = int(sizes[0]), int(cuts[-1])
            # The first bucket may continue the held one; the last may go on.
            if held_key is not None and key[0] != held_key:
                for x in bucket(np.concatenate(held), held_key, large):
                    yield out(*x)
                held, held_n, large, held_key = [], 0, False, None
            if len(cuts) > 1:
                if held_key is not None:
                    held.append(fp[:first_end])
                    held_n += first_end
                    for x in bucket(np.concatenate(held), held_key, large or held_n > bucket_limit):
                        yield out(*x)
                    held, held_n, large, held_key = [], 0, False, None
                    inner, inner_sizes = cuts[1:-1], sizes[1:-1]
                else:
                    inner, inner_sizes = cuts[:-1], sizes[:-1]
                few = (inner_sizes > 1) & (inner_sizes <= PAIRWISE)
                if few.any():
                    size_of = np.zeros(len(key), np.int64)
                    at = np.repeat(inner[few], inner_sizes[few]) + np.concatenate(
                        [np.arange(n) for n in inner_sizes[few]]
                    )
                    size_of[at] = 1
                    for shift in range(1, int(inner_sizes[few].max())):
                        same = np.flatnonzero((key[:-shift] == key[shift:]) & (size_of[:-shift] == 1))
                        if len(same):
                            near = _linked(fp[same] ^ fp[same + shift], key[same] >> _BIT)
                            if near.any():
                                yield out(fp[same[near]], fp[same[near] + shift], False)
                for start, n in zip(inner[inner_sizes > PAIRWISE], inner_sizes[inner_sizes > PAIRWISE], strict=True):
                    for x in bucket(fp[start : start + n], int(key[start]), n > bucket_limit):
                        yield out(*x)
            part = fp[last:].copy()
            held_key = int(key[-1])
            held_n += len(part)
            held.append(part)
            if held_n > bucket_limit:
                # Too large to hold: its members leave one by one.
                large = True
                yield out(np.concatenate(held), np.empty(0, np.uint64), True)
                held = [part[:0]]
        if held_key is not None and sum(map(len, held)):
            for x in bucket(np.concatenate(held), held_key, large):
                yield out(*x)

    dealt = variants(nodes, long_keys).repartition("variant").sortWithinPartitions("variant")
    return dealt.mapInArrow(run, "a long, b long")


def midpoint_links(nodes: DataFrame) -> DataFrame:
    """Links through all values within two bits: exact, and linear in the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        i, j = np.triu_indices(64, 1)
        masks = np.concatenate((np.zeros(1, np.uint64), bits, bits[i] | bits[j]))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 64):
                part = fp[at : at + 64]
                mid = (part[:, None] ^ masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part, len(masks)).view(np.int64)), pa.array(mid.view(np.int64))], ["a", "mid"]
                )

    near = nodes.select("fp").mapInArrow(run, "a long, mid long")
    lowest = near.groupBy("mid").agg(F.min("a").alias("b"), F.max("a").alias("high")).filter("b <> high")
    return near.join(lowest.select("mid", "b"), "mid").filter("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT, long_keys: int = LONG_KEYS, groups: bool = False) -> DataFrame:
    """One row per document: its fingerprint and the smallest ``doc_id`` of its component.

    ``groups``: also ``group``, a number of the component, which tells apart those that repeated ids name alike.
    """
    more = ["root"] if groups else []
    rows = materialise(fingerprints(docs), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("n"))
    nodes = materialise(nodes, "nodes")
    found = materialise(links(nodes.select("fp"), bucket_limit, nodes.count() >= long_keys), "found")
    pairs = found.filter("b is not null")
    crowded = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    if not crowded.isEmpty():
        pairs = pairs.unionByName(midpoint_links(crowded))
    roots = materialise(components(pairs), "roots")
    # Components of several fingerprints are named by their smallest document. Names
    # are met by broadcast where they are few: a component may have very many rows.
    linked = materialise(nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "lowest", "root"), "linked")
    names = linked.groupBy("root").agg(F.min("lowest").alias("component_id"))
    linked = linked.join(small_side(names), "root").select("fp", "component_id", *more)
    # All other documents but equal ones are components of their own.
    equal = nodes.filter("n > 1").join(roots, F.col("fp") == F.col("node"), "left_anti")
    named = linked.unionByName(equal.select("fp", F.col("lowest").alias("component_id"), *(F.col("fp").alias(c) for c in more)))
    named = materialise(named, "named")
    return rows.join(small_side(named.withColumn("_known", F.lit(True))), "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        *(F.coalesce(c, "fp").alias("group") for c in more),
    )
