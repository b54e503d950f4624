"""Join by content: the texts that contain a word, for lists of words of any length."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of so many rows is compared with every row of the other.
NESTED = 1_000
#: Different words of one automaton: at most so many, and so many characters. More are looked for in more passes.
PASS_WORDS, PASS_CHARS = 200_000, 4_000_000

_NUMBERS = itertools.count()
#: A worker's automaton and the number of the broadcast that it was made from.
_AUTOMATON: dict[int, ahocorasick.Automaton] = {}


def _automaton(words: Broadcast, number: int) -> ahocorasick.Automaton:
    if number not in _AUTOMATON:
        _AUTOMATON.clear()
        made = ahocorasick.Automaton()
        for k, word in enumerate(words.value):
            made.add_word(word, k)
        made.make_automaton()
        _AUTOMATON[number] = made
    return _AUTOMATON[number]


def _scan(words: Broadcast, number: int, text: str, names: list[str], rows: int = 50_000, chars: int = 16_000_000):
    """Batches of texts to rows ``(columns kept, word)``: each word that a text contains once.

    One text at a time is a Python string. It is repeated beside its words only where it is
    kept itself, by at most ``chars`` characters (or one text) in a batch that goes out.
    """
    repeated = text in names[:-1]

    def out(kept: pa.RecordBatch, at: list[int], found: list[str]) -> pa.RecordBatch:
        taken = kept.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, listed = _automaton(words, number), words.value
        for batch in batches:
            kept, texts = batch.select(names[:-1]), batch.column(text)
            at, found, held = [], [], 0
            for k in range(len(texts)):
                value = texts[k].as_py()
                if value is None:
                    continue
                hits = [listed[w] for w in {w for _, w in automaton.iter(value)}]
                length = len(value) if repeated else 0
                step = min(rows, max(1, chars // max(length, 1)))
                for i in range(0, len(hits), step):
                    some = hits[i : i + step]
                    if at and (len(at) + len(some) > rows or held + length * len(some) > chars):
                        yield out(kept, at, found)
                        at, found, held = [], [], 0
                    at += [k] * len(some)
                    found += some
                    held += length * len(some)
            if at:
                yield out(kept, at, found)

    return run


def contains_join(texts: DataFrame, words: DataFrame, text: str, word: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``texts`` (the columns ``keep``, or all) beside those of ``words`` that they contain.

    A side with few rows is broadcast and compared with all of the other. Else each text
    is read once by an Aho-Corasick automaton of up to ``PASS_WORDS`` different words; a
    longer list is cut by hash into as many automata as it needs, one pass over the texts
    each, so neither the driver nor a worker holds more of it than one pass at a time.
    Words that stand in many rows are met by an equi-join behind the search.
    A null contains nothing; everything else contains the empty word.
    """
    kept = list(texts.columns if keep is None else keep)
    told = texts.select(*dict.fromkeys([*kept, text]))
    condition = F.col(text).contains(F.col(word))
    listed = words.select(F.col(word).alias("_word")).filter("_word is not null").distinct()
    n, chars, empty = listed.agg(F.count("*"), F.coalesce(F.sum(F.length("_word")), F.lit(0)), F.bool_or(F.col("_word") == "")).first()
    if n <= NESTED:
        # Different words are few; rows of equal words are joined by equality.
        found = told.join(F.broadcast(listed), F.col(text).contains(F.col("_word"))).select(*kept, "_word")
    elif len(told.take(NESTED + 1)) <= NESTED:
        return words.join(F.broadcast(told), condition).select(*(told[c] for c in kept), *(words[c] for c in words.columns))
    else:
        passes = math.ceil(max(n / PASS_WORDS, chars / PASS_CHARS))
        schema = told.select(*kept).withColumn("_word", F.lit("")).schema
        # The empty word is in every text and in no automaton.
        found = told.filter(F.col(text).isNotNull() if empty else F.lit(False)).select(*kept, F.lit("").alias("_word"))
        numbered = listed.filter("_word <> ''").withColumn("_pass", F.pmod(F.xxhash64("_word"), F.lit(passes)))
        for k in range(passes):
            own = numbered.filter(F.col("_pass") == k).select("_word").collect()
            sent = told.sparkSession.sparkContext.broadcast([r["_word"] for r in own])
            found = found.unionByName(told.mapInArrow(_scan(sent, next(_NUMBERS), text, schema.names), schema))
    return found.join(words, F.col("_word") == F.col(word)).drop("_word")
