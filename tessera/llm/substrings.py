"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte is removed when a 50-byte string that covers it also starts in a document
with a smaller id. Each string of 50 bytes has a minimizer, the smallest hash of
the 25-byte strings inside it, so equal strings have equal minimizers wherever
they lie. Consecutive strings with one minimizer form a run.

1. Documents are gathered into blocks of about ``BLOCK`` bytes.
2. Blocks send 28 bits of each of their minimizers (besides the bucket they fall
   into) to buckets, which answer which of them other documents have as well. All
   others cannot hold a repeated string.
3. Runs with repeated minimizers go, as text, to the bucket of their minimizer;
   equal texts are one. Each bucket builds the transforms of a few shards of its
   texts and merges them: the interleave of the shards starts out arbitrary and is
   refined by the symbols of the transforms, five bytes a round, until it is in the
   order of the first 50 bytes. A round deals the places out by symbol and keeps
   their order, in linear time; no suffixes are compared or sorted anew. Where
   neighbours part in a round their common prefix ends; intervals that never part
   are the repeated strings, and each takes the smallest document that has it.
4. Blocks get the covered ranges back and cut them out.

Minimizers whose runs hold more than ``HOT`` bytes (a line that a third of the
documents have, each with other text around it; a rule of dashes, whose strings
all have one minimizer) would meet in one bucket. Their strings are matched by 128
hash bits instead: each block names its different ones once, with the smallest
and largest document, minima are aggregated before they are shuffled, and blocks
look their strings up again. Equal whole texts are matched by MD5 first.

Rows exchanged in step 2 number blocks times buckets at most, and never more than
there are different minimizers in all blocks.

Edge cases: a null text counts as empty; texts under 50 bytes lose nothing; rows
with equal ``doc_id`` do not remove each other's bytes; a null ``doc_id`` is
larger than all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, small_side, text_or_empty

LENGTH = 50
GRAM = 25
STEP = 5
BLOCK = 4 << 20
#: Positions that are hashed at once.
CHUNK = 1 << 17
#: Bytes of runs that may share a minimizer before their strings are matched one by one.
HOT = 1 << 18
SHARDS = 4
_LAST = np.iinfo(np.int64).max
#: Fewest bytes of a minimizer's runs in a block that three flag bits stand for.
_LEAST = np.array([LENGTH] + [64 << 2 * i for i in range(1, 8)], np.int64)
#: Factors of the two families of string hashes.
_FACTORS = (
    (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93),
    (0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25),
)


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _zip(array: np.ndarray) -> bytes:
    return _pack(np.ascontiguousarray(array).tobytes())


def _unzip(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_unpack(data), kind)


# --- blocks -----------------------------------------------------------------


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per block: ids, sizes and compressed texts of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int64)
            row = (number, len(texts), int(sizes.sum()), _zip(np.array(ids, np.int64)), _zip(sizes), _pack(b"".join(texts)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["block", "n", "bytes", "ids", "sizes", "data"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                ids.append(_LAST if doc_id is None else doc_id)
                texts.append(raw)
                held += len(raw) + 16
                if held >= size:
                    yield block()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "block long, n long, bytes long, ids binary, sizes binary, data binary"
    )


class Block:
    def __init__(self, ids: bytes, sizes: bytes, data: bytes) -> None:
        self.ids = _unzip(ids, "<i8")
        self.sizes = _unzip(sizes, "<i8")
        self.data = np.frombuffer(_unpack(data) if self.sizes.sum() else b"", np.uint8)
        self.ends = np.cumsum(self.sizes)


def grams(data: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of all 25-byte strings."""
    lead, *others = _FACTORS[family]
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.ascontiguousarray(words).view("<u8").ravel()
    n = len(data) - GRAM + 1
    g = words[:n] * np.uint64(lead)
    for at, factor, shift in zip((8, 16, 17), others, (29, 32, 29), strict=True):
        g ^= g >> np.uint64(shift)
        g += words[at : at + n]
        g *= np.uint64(factor)
    g ^= g >> np.uint64(32)
    return g


def runs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of strings, minimizer and document of each run."""
    found = []
    doc_of = np.repeat(np.arange(len(block.sizes), dtype=np.int32), block.sizes)
    for at in range(0, max(len(block.data) - LENGTH + 1, 0), CHUNK):
        part = block.data[at : at + CHUNK + LENGTH - 1]
        n = len(part) - LENGTH + 1
        g = grams(part)
        low = np.minimum(g[:-1], g[1:])
        for width in (2, 4, 8):
            low = np.minimum(low[:-width], low[width:])
        low = np.minimum(low[:n], low[10 : 10 + n])
        here = doc_of[at : at + n]
        valid = here == doc_of[at + LENGTH - 1 : at + LENGTH - 1 + n]
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (low[1:] != low[:-1]) | (here[1:] != here[:-1])
        starts = np.flatnonzero(begins)
        stops = np.append(np.flatnonzero(begins | ~valid), n)
        ends = stops[np.searchsorted(stops, starts, "right")]
        # Minima are small numbers: mixed once more, they spread evenly over buckets.
        mixed = low[starts] * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        found.append((starts + at, ends - starts, mixed, here[starts]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _unique(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by hash, the places there where a new one begins, and each place's number of the distinct one."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    return order, first, number


def codes(table: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket: 28 bits of each different minimizer, one whether several documents have it, three of how many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                block = Block(*parts)
                _, counts, hashes, docs = runs(block)
                order, first, _ = _unique(hashes)
                if not len(first):
                    continue
                ids = block.ids[docs[order]]
                several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
                size = np.add.reduceat(counts[order] + LENGTH - 1, first)
                flag = (np.searchsorted(_LEAST[1:], size, "right") << 1 | several).astype(np.uint32)
                h = hashes[order[first]]
                code = (h.astype(np.uint32) & np.uint32(0xFFFFFFF0)) | flag
                to = _bucket(h, buckets)
                cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                pieces = [x.tobytes() for x in np.split(code, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[cuts], pa.int64()), pa.array([number] * len(cuts), pa.int64()), pa.array(pieces, pa.binary())],
                    ["bucket", "block", "codes"],
                )

    return table.select("block", "ids", "sizes", "data").mapInArrow(run, "bucket long, block long, codes binary")


def answers(sent: DataFrame, hot: int = HOT) -> DataFrame:
    """Per block and bucket: for each code 0 (its own alone), 1 (repeated) or 2 (repeated, and in more than ``hot`` bytes)."""

    def run(group: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_py(), "<u4") for x in group.column("codes")]
        code = np.concatenate(own)
        order = np.argsort(code >> np.uint32(4), kind="stable")
        key = code[order] >> np.uint32(4)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        documents = np.add.reduceat(1 + (code[order] & np.uint32(1)).astype(np.int64), first)
        total = np.add.reduceat(_LEAST[code[order] >> np.uint32(1) & np.uint32(7)], first)
        verdict = (documents > 1).astype(np.uint8) * (1 + (total >= hot).astype(np.uint8))
        out = np.empty(len(code), np.uint8)
        out[order] = np.repeat(verdict, np.diff(np.append(first, len(key))))
        parts = np.split(out, np.cumsum([len(x) for x in own])[:-1])
        return pa.table(
            {
                "block": group.column("block"),
                "bucket": group.column("bucket"),
                "verdicts": pa.array([_zip(x) for x in parts], pa.binary()),
                "hot": pa.array([bool((x == 2).any()) for x in parts], pa.bool_()),
            }
        )

    return sent.groupBy("bucket").applyInArrow(run, "block long, bucket long, verdicts binary, hot boolean")


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return data[at]


def judged(block: Block, found: list) -> tuple[np.ndarray, ...]:
    """The runs of a block (see ``runs``) and the verdict on each."""
    starts, counts, hashes, docs = runs(block)
    order, _, distinct = _unique(hashes)
    verdict = np.concatenate([_unzip(x["verdicts"], "u1") for x in sorted(found, key=lambda x: x["bucket"])])
    of_run = np.empty(len(order), np.uint8)
    of_run[order] = verdict[distinct]
    return starts, counts, hashes, docs, of_run


def texts(joined: DataFrame, buckets: int) -> DataFrame:
    """Runs with repeated minimizers, as text, per block and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, sizes, data, found in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                block = Block(ids, sizes, data)
                starts, counts, hashes, docs, verdict = judged(block, found)
                keep = verdict == 1
                starts, counts, hashes, docs = starts[keep], counts[keep], hashes[keep], docs[keep]
                to = _bucket(hashes, buckets)
                by = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.concatenate(([True], to[by][1:] != to[by][:-1]))) if len(by) else []
                rows = []
                for piece in np.split(by, cuts[1:]) if len(by) else []:
                    rows.append(
                        (
                            int(to[piece[0]]),
                            number,
                            _zip(np.diff(starts[piece], prepend=0)),
                            _zip(counts[piece].astype(np.uint32)),
                            _zip(hashes[piece].astype(np.uint32)),
                            _zip(block.ids[docs[piece]]),
                            _zip(_gather(block.data, starts[piece], counts[piece] + LENGTH - 1)),
                        )
                    )
                give_back()
                if rows:
                    kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                        ["bucket", "block", "starts", "counts", "keys", "docs", "text"],
                    )

    return joined.select("block", "ids", "sizes", "data", "found").mapInArrow(
        run, "bucket long, block long, starts binary, counts binary, keys binary, docs binary, text binary"
    )


def _identities(data: np.ndarray, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each 50-byte string that starts from ``at`` to before ``end``."""
    part, n = data[at : end + LENGTH - 1], end - at
    out = []
    for family in (0, 1):
        g = grams(part, family)
        h = (g[:n] ^ (g[:n] >> np.uint64(29))) * np.uint64(_FACTORS[family][1]) + g[GRAM : GRAM + n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_FACTORS[family][2])
        out.append(h.view(np.int64))
    return out[0], out[1]


def singles(joined: DataFrame) -> DataFrame:
    """Per block: each different string of its hot runs once, with the smallest and the largest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, sizes, data, found in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                block = Block(ids, sizes, data)
                starts, counts, _, docs, verdict = judged(block, found)
                hot = np.flatnonzero(verdict == 2)
                if not len(hot):
                    continue
                ends = np.cumsum(counts[hot])
                place = np.arange(ends[-1]) + np.repeat(starts[hot] - (ends - counts[hot]), counts[hot])
                doc = block.ids[np.repeat(docs[hot], counts[hot])]
                h = np.empty((2, len(place)), np.int64)
                cuts = np.searchsorted(place, np.arange(0, len(block.data) + CHUNK, CHUNK))
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if b > a:
                        at = k * CHUNK
                        both = _identities(block.data, at, min(at + CHUNK, len(block.data) - LENGTH + 1))
                        for i in (0, 1):
                            h[i, a:b] = both[i][place[a:b] - at]
                order = np.lexsort((h[1], h[0]))
                h, doc = h[:, order], doc[order]
                first = np.flatnonzero(np.concatenate(([True], (h[:, 1:] != h[:, :-1]).any(0))))
                low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
                h = h[:, first]
                for at in range(0, len(first), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ascontiguousarray(x)) for x in (np.full(len(low[some]), number), h[0, some], h[1, some], low[some], high[some])],
                        ["block", "h1", "h2", "low", "high"],
                    )
                give_back()

    return joined.filter("hot").select("block", "ids", "sizes", "data", "found").mapInArrow(
        run, "block long, h1 long, h2 long, low long, high long"
    )


def earlier(named: DataFrame) -> DataFrame:
    """Per block: strings of ``singles`` that a smaller document has, packed with that document."""
    first = named.groupBy("h1", "h2").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first < last")
    first = materialise(first.drop("last"), "first")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h1", "ascending"), ("h2", "ascending")])
        packed = [_zip(group.column(c).to_numpy()) for c in ("h1", "h2", "first")]
        return pa.table({"block": group.column("block")[:1], "hots": pa.array([packed], pa.list_(pa.binary()))})

    found = named.join(small_side(first), ["h1", "h2"]).filter("high > first").select("block", "h1", "h2", "first")
    return found.groupBy("block").applyInArrow(run, "block long, hots array<binary>")


# --- transforms -------------------------------------------------------------


class Shard:
    """Rotations of strings in the order of their first 50 bytes, and their transform.

    ``symbols[i]`` is the five bytes before rotation ``order[i]``. Each string ends
    in a zero byte and is read as a ring, so what precedes its start is its end.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        first = np.repeat(ends - sizes, sizes)
        length = np.repeat(sizes, sizes)
        offset = np.arange(len(data)) - first
        key = np.zeros(len(data), np.uint64)
        for j in range(STEP):
            key = (key << np.uint64(8)) | data[first + (offset + j) % length].astype(np.uint64)
        ahead = first + (offset + STEP) % length
        # Ranks by 5, 10, 20, 40 bytes; then 50 as two overlapping stretches of 40.
        rank = _dense(key, 8 * STEP)
        bits = len(data).bit_length()
        jump, width = ahead, STEP
        while 2 * width <= LENGTH:
            rank = _dense((rank << np.uint64(bits)) | rank[jump], 2 * bits)
            jump, width = jump[jump], 2 * width
        last = first + (offset + LENGTH - width) % length
        self.order = _order((rank << np.uint64(bits)) | rank[last], 2 * bits)[0]
        self.symbols = key[first + (offset - STEP) % length][self.order]


def _order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of numbers of ``bits`` bits, ties by place, and the numbers in it."""
    low = len(key).bit_length()
    if bits + low > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort((key << np.uint64(low)) | np.arange(len(key), dtype=np.uint64))
    return (both & np.uint64((1 << low) - 1)).astype(np.int64), both >> np.uint64(low)


def _dense(key: np.ndarray, bits: int) -> np.ndarray:
    order, k = _order(key, bits)
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(np.concatenate(([0], k[1:] != k[:-1]))).astype(np.uint64)
    return out


def _dealt(symbols: np.ndarray) -> np.ndarray:
    """Places dealt out by symbol in linear time, keeping their order: numpy deals 16-bit numbers by digits."""
    if symbols.dtype == np.uint16:
        return np.argsort(symbols, kind="stable")
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    return order[np.argsort((symbols >> np.uint32(16)).astype(np.uint16)[order], kind="stable")]


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' orders by 50 bytes, and the interval number of each place.

    Every round puts five more bytes in front: places are dealt by the symbol that
    precedes them, keeping their order, which sorts the interleave by five bytes
    more. Two neighbours stay in one interval while their symbols and their earlier
    intervals agree, that is while their common prefix goes on. Symbols are numbered
    once over all shards, so that a round takes linear time.
    """
    sizes = [len(s.order) for s in shards]
    number = _dense(np.concatenate([s.symbols for s in shards]), 8 * STEP)
    number = number.astype(np.uint16 if number.max() < 1 << 16 else np.uint32)
    own = np.split(number, np.cumsum(sizes)[:-1])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    interval = np.zeros(len(number), np.int32)
    symbols = np.empty_like(number)
    for _ in range(LENGTH // STEP):
        for k, mine in enumerate(own):
            symbols[interleave == k] = mine
        order = _dealt(symbols)
        symbol, interleave, before = symbols[order], interleave[order], interval[order]
        parts = (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])
        interval = np.concatenate((np.zeros(1, np.int32), np.cumsum(parts, dtype=np.int32)))
    return interleave, interval


def smallest_documents(strings: list[bytes], docs: np.ndarray, n_shards: int = SHARDS) -> np.ndarray:
    """For each place of the strings (each with a zero byte behind), the smallest document that has its 50 bytes."""
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    ends = np.cumsum(sizes)
    # Rotations whose 50 bytes run over the end of their string are no strings of a text.
    left = np.repeat(ends, sizes) - np.arange(len(data))
    doc = np.where(left > LENGTH, np.repeat(docs, sizes), _LAST)
    cuts = np.unique(np.linspace(0, len(strings), min(n_shards, len(strings)) + 1).astype(int))
    bounds = np.concatenate(([0], ends))[cuts]
    shards = [Shard(data[a:b], sizes[i:j]) for a, b, i, j in zip(bounds, bounds[1:], cuts, cuts[1:], strict=False)]
    interleave, interval = merge(shards)
    at = np.empty(len(data), np.int64)
    for k, s in enumerate(shards):
        at[interleave == k] = s.order + bounds[k]
    first = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
    low = np.minimum.reduceat(doc[at], first)
    out = np.empty(len(data), np.int64)
    out[at] = low[interval]
    return out


def _portions(chosen: np.ndarray, keys: np.ndarray, sizes: np.ndarray, most: int = 1 << 16) -> Iterator[np.ndarray]:
    """Strings, sorted by minimizer, in portions of about ``most`` bytes that part between minimizers."""
    if not len(chosen):
        return
    new = np.flatnonzero(np.concatenate(([True], keys[chosen][1:] != keys[chosen][:-1])))
    before = np.concatenate(([0], np.cumsum(sizes[chosen])))[new]
    portion = before // most
    yield from np.split(chosen, new[np.flatnonzero(portion[1:] != portion[:-1]) + 1])


def covered(sent: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Per block: ranges of bytes, in the block's coordinates, that repeated strings cover."""

    def run(group: pa.Table) -> pa.Table:
        columns = {c: [_unzip(x.as_py(), k) for x in group.column(c)] for c, k in (("starts", "<i8"), ("counts", "<u4"), ("keys", "<u4"), ("docs", "<i8"))}
        whole = b"".join(_unpack(x.as_py()) for x in group.column("text"))
        per_row = [len(x) for x in columns["counts"]]
        starts = np.concatenate([np.cumsum(x) for x in columns["starts"]])
        counts = np.concatenate(columns["counts"]).astype(np.int64)
        keys = np.concatenate(columns["keys"])
        docs = np.concatenate(columns["docs"])
        ends = np.cumsum(counts + LENGTH - 1)
        seen: dict[bytes, int] = {}
        number = np.fromiter(
            (
                seen.setdefault(whole[a:b], len(seen))
                for a, b in zip((ends - counts - LENGTH + 1).tolist(), ends.tolist(), strict=True)
            ),
            np.int64,
            len(ends),
        )
        strings = list(seen)
        del seen, whole, ends
        lowest = np.full(len(strings), _LAST)
        np.minimum.at(lowest, number, docs)
        # Only strings that share their minimizer with others have places to compare.
        key_of = np.empty(len(strings), np.uint32)
        key_of[number] = keys
        _, inverse, n = np.unique(key_of, return_inverse=True, return_counts=True)
        chosen = np.flatnonzero(n[inverse] > 1)
        chosen = chosen[np.argsort(key_of[chosen], kind="stable")]
        sizes = np.array([len(s) - LENGTH + 1 for s in strings], np.int64)
        first = np.cumsum(sizes) - sizes
        low = np.repeat(lowest, sizes)
        for part in _portions(chosen, key_of, sizes + LENGTH):
            found = smallest_documents([strings[i] for i in part], lowest[part], n_shards)
            full = sizes[part] + LENGTH
            low[_gather(np.arange(len(low)), first[part], sizes[part])] = _gather(found, np.cumsum(full) - full, sizes[part])
        del strings
        rows = np.repeat(np.arange(len(per_row)), per_row)
        parts: dict[int, list[np.ndarray]] = {}
        # A portion of the runs at a time: their strings are many times as many.
        for at in range(0, len(counts), 1 << 13):
            c, s = counts[at : at + (1 << 13)], starts[at : at + (1 << 13)]
            hit = _gather(low, first[number[at : at + (1 << 13)]], c) < np.repeat(docs[at : at + (1 << 13)], c)
            run_of = np.repeat(np.arange(len(c)), c)
            place = np.arange(len(hit)) + np.repeat(s - (np.cumsum(c) - c), c)
            new = run_of[1:] != run_of[:-1]
            begins, closes = hit.copy(), hit.copy()
            begins[1:] &= ~hit[:-1] | new
            closes[:-1] &= ~hit[1:] | new
            pairs = np.stack((place[begins], place[closes] + LENGTH), 1)
            row = rows[at + run_of[begins]]
            cuts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else []
            for i, p in zip(row[cuts], np.split(pairs, cuts[1:]) if len(row) else [], strict=True):
                parts.setdefault(int(i), []).append(p)
        block = group.column("block").to_pylist()
        out = pa.table(
            {
                "block": pa.array([block[i] for i in parts], pa.int64()),
                "ranges": pa.array([_zip(np.concatenate(p)) for p in parts.values()], pa.binary()),
            }
        )
        del low, number, docs, counts, starts, parts
        give_back()
        return out

    return sent.groupBy("bucket").applyInArrow(run, "block long, ranges binary")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_places(block: Block, h1: np.ndarray, h2: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """Places of strings, named by their hashes in order, that start in a document after ``first``."""
    doc_of = np.repeat(np.arange(len(block.sizes), dtype=np.int32), block.sizes)
    # Most strings are none of those: sixteen bits of the hash tell, before a search.
    may = np.zeros(1 << 16, bool)
    may[h1 & 0xFFFF] = True
    for at in range(0, max(len(block.data) - LENGTH + 1, 0), CHUNK):
        end = min(at + CHUNK, len(block.data) - LENGTH + 1)
        g1, g2 = _identities(block.data, at, end)
        some = np.flatnonzero(may[g1 & 0xFFFF] & (doc_of[at:end] == doc_of[at + LENGTH - 1 : end + LENGTH - 1]))
        found = np.minimum(np.searchsorted(h1, g1[some]), len(h1) - 1)
        hit = (h1[found] == g1[some]) & (h2[found] == g2[some])
        place = some[hit] + at
        yield place[first[found[hit]] < block.ids[doc_of[place]]]


def cut(joined: DataFrame) -> DataFrame:
    """One row per document, after the covered ranges are cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, data, ranges, hots in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                block = Block(ids, sizes, data)
                depth = np.zeros(len(block.data) + 1, np.int32)
                for x in ranges or ():
                    pairs = _unzip(x, "<i8").reshape(-1, 2)
                    np.add.at(depth, pairs[:, 0], 1)
                    np.add.at(depth, pairs[:, 1], -1)
                for place in repeated_places(block, *(_unzip(x, "<i8") for x in hots)) if hots else ():
                    depth[place] += 1
                    depth[place + LENGTH] -= 1
                gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
                rows = []
                for doc_id, a, b in zip(block.ids.tolist(), (block.ends - block.sizes).tolist(), block.ends.tolist(), strict=True):
                    out = gone[a:b]
                    n = int(np.count_nonzero(out))
                    spans = int(np.count_nonzero(out[1:] & ~out[:-1])) + int(bool(n and out[0]))
                    left = block.data[a:b][~out] if n else block.data[a:b]
                    rows.append((None if doc_id == _LAST else doc_id, b - a, n, spans, hashlib.sha256(left.tobytes()).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return joined.select("ids", "sizes", "data", "ranges", "hots").mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame, block: int = BLOCK, hot: int = HOT, n_shards: int = SHARDS) -> DataFrame:
    """One row per document: its bytes, those removed, the removed spans and a digest of the rest."""
    own = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text"))
    own = own.withColumn("digest", F.md5(F.col("text").cast("binary")))
    # Of equal texts only those with the smallest id take part; the others are repeats as a whole.
    place = F.coalesce("doc_id", F.lit(_LAST))
    sizes = materialise(own.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    first = sizes.filter(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = materialise(sizes.join(small_side(first, 500_000), "digest").filter(place > F.col("first")).drop("first", "n"), "copies")
    gone = small_side(copies.select(place.alias("_id"), F.col("digest").alias("_digest")).distinct(), 1_000_000)
    left = own.join(gone, (place == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_anti")
    table = materialise(blocks(left, block), "blocks")
    total = table.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(4, math.ceil(total / (32 << 20)))
    sent = codes(table, buckets)
    told = answers(sent, hot).groupBy("block").agg(F.collect_list(F.struct("bucket", "verdicts")).alias("found"), F.max("hot").alias("hot"))
    told = materialise(told, "verdicts")
    repeated = texts(table.join(told, "block"), 4 * buckets)
    ranges = covered(repeated, n_shards).groupBy("block").agg(F.collect_list("ranges").alias("ranges"))
    ranges = materialise(ranges, "ranges")
    hots = materialise(earlier(materialise(singles(table.join(told, "block")), "singles")), "hots")
    out = cut(table.join(ranges, "block", "left").join(hots, "block", "left"))
    none = F.lit(0).cast("long")
    removed = copies.select(
        "doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), (none + 1).alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256")
    )
    return out.unionByName(removed)
