"""Benchmark decontamination by canonical templates.

Texts become sequences of template words: numbers, names and units turn into
typed placeholders, other words are lower-cased and lose their punctuation, words
of marks alone vanish. Windows of five template words are hashed and joined with
those of the benchmark, so a question whose parameters were changed still matches.
A match then has to be consistent: along one alignment of item and document, each
placeholder value of the item must stand for one value of the document.

A window that has placeholders is joined in up to three forms: with all of them,
with those of numbers and units alone, and with none, as it is written. The latter
two make a match independent of case and of what stands before the window, which
both bear on what counts as a name. An item's first word, where it may be a name,
is taken either way. A document is contaminated by an item when at least
``threshold`` of the item's windows occur in it.

A name of several words may become one of a single word, and the other way round: texts with
capitalised words in a row are read a second time with each such row as one name. ``$5`` and
``5 dollars`` are one thing.

Windows that are mostly placeholders match as written only, and count where the
others alone do not reach the share. Items of fewer than five words are one window
of all their words; it is looked for in whole texts and, from ``LEAST_WORDS``
words on, anywhere in longer ones (one or two words are no evidence there).

Native throughout. The windows of a text are joined inside its own task while the
benchmark's windows are few (checked by counting them). Beyond that bound windows
that no item has are dropped first, by a counted broadcast of hashes, and the rest
is shuffled by window.

Edge cases: null or empty texts and items, and those of marks alone, have no
windows and never match; a re-parameterised copy in capitals or in lower case is missed where its
names changed as well; repeated items with one id keep the smallest text; documents
with equal ids count as one; an empty table on either side gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, materialise, single_spaces, small_side, text_or_empty, word_grams

WINDOW = 5
THRESHOLD = 0.8
#: Literal words that a window must have.
MIN_LITERALS = 3
#: Words that an item shorter than a window must have to be looked for inside longer texts.
LEAST_WORDS = 3
#: Benchmark windows (about 150 bytes each) that are sent to every executor at most.
BROADCAST_WINDOWS = 200_000
#: Hashes of benchmark windows that are sent at most where the windows are too many.
BROADCAST_HASHES = 4_000_000

# Units that follow a number.
UNITS = (
    "mm cm m km in ft yd mi miles mile meters metres meter metre feet foot inches inch "
    "mg g kg t lb lbs oz grams gram kilograms kilogram pounds pound tons ton "
    "ml l liters litres liter litre gallons gallon s sec seconds second min minutes minute h hr hours hour "
    "days day weeks week months month years year kb mb gb tb hz khz mhz ghz w kw mw v kv a j kj cal kcal "
    "mph kph percent dollars dollar usd euros euro eur cents cent degrees degree"
).split()

NUMBER, NAME, UNIT, VALUE = "\x01", "\x02", "\x03", "\x04"
#: Stands between the words of a name of several words where they are read as one.
JOIN = "\x05"
#: Two capitalised words in a row, as in a name of several words.
RUN = rf"\p{{Lu}}\p{{Ll}}++[{WS}]++\p{{Lu}}\p{{Ll}}"
_VALUE = rf"{VALUE}[^ {NUMBER}-{VALUE}]*+"


def canonical(text: Column, first_name: bool = False, joined: bool = False) -> Column:
    """Words parted by single spaces; a placeholder is its type, ``VALUE`` and what it stands for.

    ``joined``: names that follow one another (of words of up to 40 letters) are one.

    Patterns begin with the character they replace and look behind afterwards, so
    most characters cost one class test.
    """
    own = NUMBER + NAME + UNIT + VALUE + JOIN
    marked = reduce(or_, (F.contains(text, F.lit(c)) for c in own))
    out = single_spaces(F.when(marked, F.translate(text, own, "")).otherwise(text))
    out = F.regexp_replace(out, r"\p{Lu}(?<=[^.!?:; ] .)\p{Ll}++", NAME + VALUE + "$0")
    if first_name:
        out = F.regexp_replace(out, r"^([^\p{L}\p{N}]*+)(\p{Lu}\p{Ll}++)", "$1" + NAME + VALUE + "$2")
    if joined:
        out = F.regexp_replace(out, rf"(?<={VALUE}\p{{Lu}}\p{{Ll}}{{1,40}}) {NAME}{VALUE}(?=\p{{Lu}})", JOIN)
    number = r"[0-9](?<![\p{L}\p{N}].)[0-9]*+(?:[.,:/][0-9]++)*+%?"
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    # A sum of money has its unit behind it, however it is written.
    numbered = out
    for sign, unit in (("[$]", "dollars"), ("€", "euros")):
        numbered = F.regexp_replace(numbered, rf"{sign} ?([0-9]++(?:[.,][0-9]++)*+)", f"$1 {unit}")
    numbered = F.regexp_replace(numbered, number, NUMBER + VALUE + "$0")
    numbered = F.regexp_replace(
        numbered, rf"({NUMBER}{VALUE}[0-9.,:/%]++)( ?)((?i:{units}))(?![\p{{L}}\p{{N}}])", f"$1$2{UNIT}{VALUE}$3"
    )
    out = F.lower(F.when(text.rlike("[0-9]"), numbered).otherwise(out))
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}} {NUMBER}-{JOIN}]++", "")
    return F.btrim(single_spaces(out), F.lit(" "))


def _forms(gram: str = "gram") -> Column:
    """Hashes of the forms of a window: with all placeholders, with those of numbers and units, as written; equal ones once.

    A window with a joined name has the first alone: how the name is written tells nothing of one word more or fewer.
    """
    marked = F.col(gram)
    typed = lambda x: F.xxhash64(F.regexp_replace(x, _VALUE, ""))
    written = F.xxhash64(F.translate(marked, NUMBER + NAME + UNIT + VALUE, ""))
    return (
        F.when(~F.contains(marked, F.lit(VALUE)), F.array(F.xxhash64(marked)))
        .when(F.contains(marked, F.lit(JOIN)), F.array(typed(marked)))
        .when(~_mixed(marked), F.array(typed(marked), written))
        .otherwise(F.array(typed(marked), typed(_bare(marked)), written))
    )


def _mixed(marked: Column) -> Column:
    return F.contains(marked, F.lit(NAME)) & F.contains(marked, F.lit(NUMBER))


def _bare(marked: Column) -> Column:
    return F.replace(marked, F.lit(NAME + VALUE), F.lit(""))


def _marked(gram: str, form: str) -> Column:
    """The window with the values of the placeholders that its form has; null as written."""
    marked, number = F.col(gram), F.col(form)
    plain = ~F.contains(marked, F.lit(VALUE))
    return F.when(~plain & (number == 0), marked).when(~plain & (number == 1) & _mixed(marked), _bare(marked))


def windows(
    rows: DataFrame, keys: Sequence[str], size: int = WINDOW, shorter: Sequence[int] = (), first_name: bool = False, joined: bool = False
) -> DataFrame:
    """``(keys, at, gram, form, window)``: the windows of each text in all their forms, also those of ``shorter`` sizes.

    A text of fewer than ``size`` words is one window. ``joined``: of texts with names of
    several words alone, these read as one.
    """
    if joined:
        rows = rows.filter(F.col("text").rlike(RUN))
    # A filter on the canonical text would make it a second time; of an empty one the windows are none.
    rows = rows.select(*keys, canonical(F.col("text"), first_name, joined).alias("canonical"))
    n = F.length("canonical") - F.length(F.translate("canonical", " ", "")) + 1
    nothing = F.array().cast("array<string>")
    grams = F.when(F.col("canonical") == "", nothing).when(n < size, F.array("canonical")).otherwise(word_grams("canonical", size))
    for k in shorter:
        grams = F.concat(grams, F.when(n > k, word_grams("canonical", k)).otherwise(nothing))
    # The outer form: for the inner one the optimizer adds a filter on the array's
    # size, for which it would build the array once more.
    rows = rows.select(*keys, F.posexplode_outer(grams).alias("at", "gram")).filter("gram is not null")
    return rows.select(*keys, "at", "gram", F.posexplode_outer(_forms()).alias("form", "window"))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(item_id, reading, item_at, words, window, item_marked, typed)``: the windows by which an item is found.

    An item with names of several words has a second reading, in which each is one word.
    """
    items = (
        benchmark.select(F.col("item_id").cast("long"), text_or_empty().cast("string").alias("text"))
        .filter("item_id is not null")
        .groupBy("item_id")
        .agg(F.min("text").alias("text"))
    )
    keys = ["item_id", "reading"]
    own = None
    for reading in (0, 1):
        rows = items.withColumn("reading", F.lit(reading))
        read = windows(rows, keys, size, joined=reading == 1)
        read = read.unionByName(windows(rows, keys, size, first_name=True, joined=reading == 1).filter("at = 0"))
        own = read if own is None else own.unionByName(read)
    own = own.withColumn("marked", _marked("gram", "form"))
    words = F.size(F.split("gram", " "))
    literal = words - F.size(F.filter(F.split("marked", " "), lambda x: F.contains(x, F.lit(VALUE))))
    own = own.withColumn("words", words).filter(F.col("marked").isNull() | (literal >= F.least(F.lit(MIN_LITERALS), F.col("words") - 1)))
    typed = F.col("marked").isNotNull() | ~F.contains("gram", F.lit(VALUE))
    own = own.groupBy(*keys, "at", "words", "window").agg(F.max("marked").alias("item_marked"), F.max(typed).alias("typed"))
    flags = own.groupBy(*keys, "at").agg(F.max("typed").alias("typed"))
    return own.drop("typed").join(flags, [*keys, "at"]).withColumnRenamed("at", "item_at")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, size: int = WINDOW) -> DataFrame:
    """``(doc_id, item_id, matched, windows, share, first_word)`` for each contaminated pair."""
    items = materialise(benchmark_windows(benchmark, size), "items")
    n_items, = items.agg(F.count("*")).first()
    # At most `size` different numbers.
    shorter = sorted(r["words"] for r in items.select("words").distinct().collect() if LEAST_WORDS <= r["words"] < size)
    totals = items.groupBy("item_id", "reading").agg(
        F.count_distinct("item_at").alias("all_windows"), F.count_distinct(F.when(F.col("typed"), F.col("item_at"))).alias("typed_windows")
    )
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text")).filter("doc_id is not null")
    own = windows(texts, ["doc_id"], size, shorter).withColumn("joined", F.lit(False))
    # Names of several words may stand for one word of the item: only the windows that have them are new.
    more = windows(texts, ["doc_id"], size, shorter, joined=True).filter(F.contains("gram", F.lit(JOIN)))
    own = own.unionByName(more.withColumn("joined", F.lit(True)))
    side = items.drop("words")
    if n_items <= BROADCAST_WINDOWS:
        side = F.broadcast(side)
    else:
        own = own.join(small_side(side.select("window").distinct(), BROADCAST_HASHES), "window", "left_semi")
    hits = own.join(side, "window").select(
        "doc_id",
        "item_id",
        "reading",
        "joined",
        "at",
        "item_at",
        "typed",
        (F.col("at") - F.col("item_at")).alias("shift"),
        "item_marked",
        _marked("gram", "form").alias("marked"),
    )
    hits = materialise(hits, "hits")
    # Along one alignment of one reading of each a value of the item stands for one value of the document.
    values = rf"[{NUMBER}-{UNIT}]{VALUE}([^ {NUMBER}-{VALUE}]*+)"
    slots = F.arrays_zip(
        F.regexp_extract_all("item_marked", F.lit(values), F.lit(1)).alias("item"),
        F.regexp_extract_all("marked", F.lit(values), F.lit(1)).alias("doc"),
    )
    place = ["doc_id", "item_id", "reading", "joined", "shift"]
    changed = F.col("marked").isNotNull() & F.col("item_marked").isNotNull()
    inconsistent = (
        hits.filter(changed)
        .select(*place, F.explode(slots).alias("s"))
        .groupBy(*place, "s.item")
        .agg(F.min("s.doc").alias("low"), F.max("s.doc").alias("high"))
        .filter("low <> high")
        .select(*place)
        .distinct()
    )
    kept = hits.filter(changed).join(inconsistent, place, "left_anti").unionByName(hits.filter(~changed))
    matched = kept.groupBy("doc_id", "item_id", "reading").agg(
        F.count_distinct("item_at").alias("all_matched"),
        F.count_distinct(F.when(F.col("typed"), F.col("item_at"))).alias("typed_matched"),
        F.min("at").cast("long").alias("first_word"),
    )
    # The windows with enough literal words decide, or else all of them.
    few = (F.col("typed_windows") == 0) | (F.col("typed_matched") < threshold * F.col("typed_windows"))
    found = (
        matched.join(F.broadcast(totals) if n_items <= BROADCAST_WINDOWS else totals, ["item_id", "reading"])
        .withColumn("matched", F.when(few, F.col("all_matched")).otherwise(F.col("typed_matched")))
        .withColumn("windows", F.when(few, F.col("all_windows")).otherwise(F.col("typed_windows")))
        .withColumn("share", F.round(F.col("matched") / F.col("windows"), 6))
        .filter(F.col("matched") >= threshold * F.col("windows"))
    )
    # The reading that matches best.
    best = F.max_by(F.struct("matched", "windows", "share", "first_word"), F.struct("share", -F.col("reading"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
