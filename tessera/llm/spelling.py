"""Spelling variants by Aho-Corasick halves.

A word is cut in two segments. One inserted, deleted or replaced code point leaves one of
them whole, so of two words that differ by one edit each has a whole segment of the other
at its begin or at its end. Automata hold the segments of all words; every word is scanned,
a hit counts if the segment stands at its own end of the word and the lengths differ by at
most one, and the distance is verified.

Shards: the first segment can only be met at a word's first two characters and the second
at its last two, so a word is scanned by the shards of those two pairs alone. A pair with
more words than a shard holds becomes a square of shards, each with one part of its words
as segments and one as texts; no shard has more than twice its capacity of words. Segments
that many words share (two letters of a five-letter word) are not scanned word by word: the
rests beside such a segment are indexed by themselves and their one-deletion variants, so a
hit costs as many steps as the word has letters.

A word's form is the most frequent near word, ties by code-point order, if it is at least
``ratio`` times as frequent. Forms grow in frequency, so chains end after as many steps as
the largest count has bits; roots are found by pointer doubling in the logarithm of that.

Edge cases: a null text has no words, a null document id reads as empty in the checksum;
repeated rows count again; words without near words have ``n_near`` 0; an empty table gives
no rows; other columns are ignored. A run of any length is one word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, text_or_empty, written

RUN = "[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Character pairs are hashed into so many cells for each end of a word, which bounds the plan of shards.
CELLS = 4096
#: Words of a shard: as few as keep all cores busy, at most what a task holds with ease.
LEAST_SHARD, MOST_SHARD = 10_000, 200_000
#: Words with one segment in common from which their rests are indexed.
CROWD = 12


def damaged(run: str | Column, doc_id: str | Column, every: int = 97) -> Column:
    """``run`` without one code point where ``every`` divides the checksum of the document and the run."""
    run, doc_id = (F.col(c) if isinstance(c, str) else c for c in (run, doc_id))
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, run)``: every maximal run of letters, A-Z in lower case."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(text_or_empty(), F.lit(RUN), F.lit(0))).alias("run"))
    return found.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def vocabulary(docs: DataFrame, least: int = MIN_COUNT, chars: int = MIN_CHARS) -> DataFrame:
    """``(word, n)`` of the documents' damaged runs. Runs shorter than a word can be are left out before counting."""
    words = runs(docs).filter(F.length("run") >= chars).select(damaged("run", "doc_id").alias("word"))
    counted = words.filter(F.length("word") >= chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


def deletions(rest: str) -> set[str]:
    return {rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}


class Segment:
    """The words of a shard that have one segment at one end, with what stands beside it."""

    def __init__(self) -> None:
        self.rests: list[tuple[str, str]] = []
        self.index: dict[str, list[str]] | None = None

    def candidates(self, rest: str) -> Iterator[str]:
        if len(self.rests) <= CROWD:
            yield from (word for own, word in self.rests if abs(len(own) - len(rest)) <= 1)
            return
        if self.index is None:
            self.index = {}
            for own, word in self.rests:
                for x in deletions(own):
                    self.index.setdefault(x, []).append(word)
        seen = set()
        for x in deletions(rest):
            for word in self.index.get(x, ()):
                if word not in seen:
                    seen.add(word)
                    yield word


def scan(rows: pd.DataFrame) -> pd.DataFrame:
    """For each text of a shard its near words there: how many, and the most frequent one."""
    segments: dict[tuple[str, int], Segment] = {}
    automaton = ahocorasick.Automaton()
    counts = dict(zip(rows["word"], rows["n"], strict=True))
    held = rows[rows["pattern"]]
    for word, side in zip(held["word"], held["side"], strict=True):
        own, rest = halves(word) if side == 0 else halves(word)[::-1]
        segments.setdefault((own, side), Segment()).rests.append((rest, word))
        automaton.add_word(own, own)
    if not segments:
        return pd.DataFrame({"word": [], "n_near": [], "form": [], "form_n": []})
    automaton.make_automaton()
    out = []
    texts = rows[rows["scanned"]]
    for text, side in zip(texts["word"], texts["side"], strict=True):
        near, best = 0, None
        for end, own in automaton.iter(text):
            # The offset of the segment: the begin for first segments, the end for second ones.
            if (end + 1 != len(own)) if side == 0 else (end + 1 != len(text)):
                continue
            segment = segments.get((own, side))
            if segment is None:
                continue
            for word in segment.candidates(text[len(own) :] if side == 0 else text[: len(text) - len(own)]):
                # A word whose two segments both stand in the text is met by the first.
                if one_edit(text, word) and not (side and text.startswith(halves(word)[0])):
                    near += 1
                    if best is None or (-counts[word], word) < best:
                        best = (-counts[word], word)
        if best:
            out.append((text, near, best[1], -best[0]))
    return pd.DataFrame(out, columns=["word", "n_near", "form", "form_n"])


def shards(words: DataFrame, capacity: int | None = None) -> DataFrame:
    """Rows ``(shard, side, word, n, pattern, scanned)``: each word's segments and itself, where they can meet."""
    spark = words.sparkSession
    sides = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    pair = F.when(F.col("side") == 0, F.substring("word", 1, 2)).otherwise(F.substring("word", -2, 2))
    sides = sides.withColumn("cell", F.pmod(F.xxhash64(pair), F.lit(CELLS)).cast("int"))
    # At most 2 x CELLS rows, whatever the vocabulary.
    cells = [(r["side"], r["cell"], r["count"]) for r in sides.groupBy("side", "cell").count().collect()]
    if capacity is None:
        total = sum(n for _, _, n in cells)
        capacity = min(MOST_SHARD, max(LEAST_SHARD, math.ceil(total / (4 * spark.sparkContext.defaultParallelism))))
    plan, shard, load = [], 0, 0
    for side, cell, n in sorted(cells):
        parts = math.ceil(n / capacity)
        if parts == 1:
            if load + n > capacity:
                shard, load = shard + 1, 0
            load += n
            plan.append((side, cell, shard, 1))
        else:
            # One after the shard being filled, which stays the last.
            plan.append((side, cell, shard + 1, parts))
            shard, load = shard + 1 + parts * parts, 0
    placed = spark.createDataFrame(plan, "side int, cell int, first int, parts int")
    placed = sides.join(F.broadcast(placed), ["side", "cell"])
    part = F.pmod(F.xxhash64("word", F.lit(3)), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)

    def role(at: Column, pattern: bool, scanned: bool) -> Column:
        return F.struct(at.cast("int").alias("shard"), F.lit(pattern).alias("pattern"), F.lit(scanned).alias("scanned"))

    square = F.concat(
        F.transform(every, lambda j: role(F.col("first") + F.col("part") * F.col("parts") + j, True, False)),
        F.transform(every, lambda i: role(F.col("first") + i * F.col("parts") + F.col("part"), False, True)),
    )
    roles = F.when(F.col("parts") == 1, F.array(role(F.col("first"), True, True))).otherwise(square)
    return placed.withColumn("part", part).select("side", "word", "n", F.inline(roles))


def forms(words: DataFrame, ratio: int = RATIO, capacity: int | None = None) -> DataFrame:
    """``(word, n, n_near, form, form_n)`` of distinct ``words (word, n)``."""
    found = shards(words, capacity).groupBy("shard").applyInPandas(scan, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    all_words = words.join(found, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    return all_words.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )


def roots(found: DataFrame) -> DataFrame:
    """``(word, root)`` of the words with a form: the last word of the chain of forms."""
    spark = found.sparkSession
    links, path = written(found.filter("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        before, (links, path) = path, written(moved, "forms")
        discard(spark, before)
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO, capacity: int | None = None) -> DataFrame:
    """``words`` with ``form``, ``root``, ``n_near`` and ``form_n``."""
    found = materialise(forms(materialise(words, "words"), ratio, capacity), "variants")
    return found.join(roots(found), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    return group_variants(vocabulary(docs))
