"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenised once; only those longer than a sequence are cut. Pieces
above a third of a sequence are matched greedily, at most two to a bin (the
largest with the largest that still fits); smaller pieces go, largest first, to
the bin with the tightest gap that takes them.

Pieces of one length are interchangeable, so the plan is made from the counts of
lengths alone: at most ``capacity`` numbers, however large the corpus is. The
plan names runs of pieces (length, rank range) and runs of bins; executors then
look up their pieces' places by rank.

Edge cases: a null or empty text is the end token alone (one piece of length 1);
an empty table packs into no rows; equal ``doc_id`` rows are separate documents;
other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, held, materialise

CAPACITY = 4096
EOS = 1
#: Entries of one generation of a Python worker's chunk cache; two are kept.
CACHE_ENTRIES = 400_000
#: Marks that are a token group of their own behind letters.
MARKS = b".,!?*&%#;:"
#: Such marks at the end of a chunk, directly behind a letter.
_BEHIND = re.compile(rb"[.,!?*&%#;:](?<=[a-z].)[.,!?*&%#;:]*(?!\S)")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def letters(word: bytes) -> bool:
    """Whether a word is of letters alone, also after it is normalised and lower-cased."""
    if word.isalpha():
        return True
    text = word.decode("utf-8", "replace")
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())


class Chunks(dict):
    """Little-endian ids of a chunk between ASCII white space.

    The tokenizer drops white space and never joins tokens across it, so a text's
    ids are those of its chunks in turn. Letters are lower-cased by the tokenizer,
    and a run of marks after letters is a token group of its own, so both are
    looked up by part.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.entries = entries
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def keep(self, chunk: bytes, ids: bytes) -> None:
        if len(chunk) <= 48:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids

    def __missing__(self, chunk: bytes) -> bytes:
        low = chunk.lower()
        word = low.rstrip(MARKS)
        if (ids := self.older.get(chunk)) is not None:
            pass
        elif low != chunk and b"<" not in chunk:
            ids = self[low]
        elif word != low and letters(word):
            ids = self[word] + self[low[len(word) :]]
        else:
            found = self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids
            ids = np.array(found, "<u4").tobytes()
        self.keep(chunk, ids)
        return ids

    def learn(self, chunks: set[bytes]) -> None:
        """Look up new words many at a time: each word of letters is one group, so its tokens end with one that ends a word."""
        words = {w for c in chunks if c not in self.older and len(w := c.rstrip(MARKS)) <= 48}
        new = [w for w in words if w not in self and w not in self.older and letters(w)]
        for at in range(0, len(new), 512):
            part = new[at : at + 512]
            text = b" ".join(part).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            # Where letters change into others under normalisation, words are looked up one by one.
            if len(ends) == len(part):
                raw, starts = ids.tobytes(), [0, *ends.tolist()]
                for word, a, b in zip(part, starts, starts[1:], strict=False):
                    self.keep(word, raw[4 * a : 4 * b])

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        split = []
        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            # The tokenizer lower-cases all but its special tokens.
            # White space between letters and marks changes no token, and words then are looked up without them.
            split.append((raw if b"<|" in raw else _BEHIND.sub(rb" \g<0>", raw.lower())).split())
        different = set(chain.from_iterable(split))
        self.learn(set(filterfalse(self.__contains__, different)))
        # A small dictionary of this portion's words stays in the processor's cache.
        ids = {w: self[w] for w in different}
        return [b"".join(map(ids.__getitem__, words)) for words in split]


def coder(path: str, entries: int = CACHE_ENTRIES) -> Chunks:
    return held(f"chunks {entries} {path}", lambda: Chunks(path, entries))


def tokenise(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, eos: int = EOS, entries: int = CACHE_ENTRIES
) -> DataFrame:
    """One row per piece: its place in its document, its length and a checksum of its ids."""
    end = eos.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = coder(tokenizer, entries)
        for batch in batches:
            rows: list[tuple] = []
            for first in range(0, batch.num_rows, 64):
                some = batch.slice(first, 64)
                coded = chunks.encode(some.column(1).to_pylist())
                for doc_id, found in zip(some.column(0).to_pylist(), coded, strict=True):
                    ids = found + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Runs ``(length, first_rank, end_rank, per_bin, first_bin, offset)`` and the number of bins.

    Piece ``r`` of such a run lies in bin ``first_bin + (r - first_rank) // per_bin``
    at ``offset + (r - first_rank) % per_bin * length``.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    placed = dict.fromkeys(left, 0)
    runs: list[tuple] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    bins = 0

    def put(size: int, n_bins: int, per_bin: int, first_bin: int, offset: int, items: int | None = None) -> None:
        items = n_bins * per_bin if items is None else items
        runs.append((size, placed[size], placed[size] + items, per_bin, first_bin, offset))
        placed[size] += items
        left[size] -= items

    def leave(first: int, end: int, gap: int) -> None:
        if gap and end > first:
            if gap not in gaps:
                insort(open_gaps, gap)
                gaps[gap] = []
            gaps[gap].append((first, end))

    large = sorted(s for s in left if 3 * s > capacity)
    available = list(large)
    for size in reversed(large):
        while left[size]:
            at = bisect_left(available, min(size, capacity - size) + 1) - 1
            partner = available[at] if at >= 0 else None
            if partner == size and left[size] == 1:
                partner = available[at - 1] if at else None
            if partner is None:
                n = left[size]
                put(size, n, 1, bins, 0)
                leave(bins, bins + n, capacity - size)
            elif partner == size:
                n = left[size] // 2
                put(size, n, 2, bins, 0)
                leave(bins, bins + n, capacity - 2 * size)
            else:
                n = min(left[size], left[partner])
                put(size, n, 1, bins, 0)
                put(partner, n, 1, bins, size)
                leave(bins, bins + n, capacity - size - partner)
                if not left[partner]:
                    available.remove(partner)
            bins += n
        if size in available:
            available.remove(size)

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(open_gaps, size)
            if at == len(open_gaps):
                per = capacity // size
                first, end, gap = bins, bins + -(-left[size] // per), capacity
                bins = end
            else:
                gap = open_gaps[at]
                first, end = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
                per = gap // size
            full = min(end - first, left[size] // per)
            if full:
                put(size, full, per, first, capacity - gap)
                leave(first, first + full, gap - per * size)
                first += full
            if first < end and left[size]:
                rest = left[size]
                put(size, 1, per, first, capacity - gap, rest)
                leave(first, first + 1, gap - rest * size)
                first += 1
            leave(first, end, gap)
    return runs, bins


def by_block(runs: list[tuple], counts: dict[int, int]) -> tuple[dict[int, int], list[tuple]]:
    """Ranks per block for each length, and the runs with each block that they reach into.

    A length has as many blocks as runs, so there are at most twice as many rows as
    runs, and a piece meets two runs on average, however the runs are spread.
    """
    per_length: dict[int, int] = {}
    for run in runs:
        per_length[run[0]] = per_length.get(run[0], 0) + 1
    steps = {size: max(1, -(-counts[size] // n)) for size, n in per_length.items()}
    blocks = []
    for size, first, end, *place in runs:
        step = steps[size]
        blocks += [(size, block, first, end, *place) for block in range(first // step, (end - 1) // step + 1)]
    return steps, blocks


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, eos: int = EOS, entries: int = CACHE_ENTRIES
) -> DataFrame:
    """Each piece with its sequence and its offset there."""
    spark = docs.sparkSession
    pieces = materialise(tokenise(docs, tokenizer, capacity, eos, entries), "pieces")
    # At most `capacity` rows: lengths lie between 1 and capacity.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    ranked = gapless_rank(pieces, "length", ["doc_id", "piece"], counts or {0: 0}, "rank")
    kinds = "length long, block long, first_rank long, end_rank long, per_bin long, first_bin long, first_offset long"
    steps, blocks = by_block(runs, counts)
    steps = spark.createDataFrame(list(steps.items()) or [(0, 1)], "length long, step long")
    places = spark.createDataFrame(blocks or [(0, 0, 0, 0, 1, 0, 0)], kinds)
    # Both sides are bounded by the plan, that is by the number of lengths, not by the rows.
    return (
        ranked.join(F.broadcast(steps), "length")
        .withColumn("block", F.expr("rank div step"))
        .join(F.broadcast(places), ["length", "block"])
        .filter("rank >= first_rank and rank < end_rank")
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            F.expr("first_bin + (rank - first_rank) div per_bin").alias("sequence_id"),
            F.expr("first_offset + (rank - first_rank) % per_bin * length").alias("offset"),
        )
    )
