"""Quality rules by the frequency of lines across documents.

Lines are normalised (lower case, white space runs as one space) and hashed; for
each host the different documents that hold a line are counted. A line is removed
where they exceed the host's limit: ``share`` of its documents, but ``min_docs`` at
least and ``max_docs`` at most, so that the rule reaches boilerplate of small hosts
and of those that hold a third of a corpus. Copies are documents like others; with
``copies=False`` documents of equal text count once. A document is rejected when
removal leaves it depleted: less than half of its characters or fewer than
``min_words`` words. In-document counts (words, symbols, repeated lines and
windows) give the base verdict.

All of it is native: one narrow pass per text, then rows for lines only.

Edge cases: a null or empty text has no words and fails the base; a null source
is a host of its own; rows with equal ``doc_id`` are one document to the line
counts; a null ``doc_id`` loses no lines; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, materialise, small_side, text_or_empty

MIN_DOCS = 10
MAX_DOCS = 1000
SHARE = 0.01
MAX_LOSS = 0.5
MIN_WORDS = 10
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\f\r"


def _measures(docs: DataFrame) -> DataFrame:
    """One row per document: in-document counts, its host, a hash of its text and its hashed lines."""
    blank = F.lit(_BLANKS)
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("host"),
        text_or_empty().cast("string").alias("text"),
    )
    rows = rows.withColumn("trimmed", F.btrim("text", blank))
    rows = rows.withColumn(
        "words",
        F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", f"[{WS}]+")),
    ).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != ""))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    rows = rows.withColumn(
        "windows",
        F.expr(
            "case when n_words < 6 then cast(array() as array<bigint>) else transform(sequence(0, cast(n_words as int) - 5),"
            " i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])) end"
        ),
    )
    # Positions of windows that occur twice or more: neighbours after a sort by hash.
    rows = rows.withColumn(
        "sorted",
        F.expr(
            "case when size(array_distinct(windows)) = size(windows) then null"
            " else sort_array(transform(windows, (h, i) -> struct(h as h, i as i))) end"
        ),
    )
    rows = rows.withColumn(
        "repeats",
        F.expr(
            "case when sorted is null then null else sort_array(transform(filter(sequence(0, size(sorted) - 1),"
            " j -> (j > 0 and sorted[greatest(j - 1, 0)].h = sorted[j].h)"
            " or (j < size(sorted) - 1 and sorted[least(j + 1, size(sorted) - 1)].h = sorted[j].h)),"
            " j -> sorted[j].i)) end"
        ),
    )
    squeezed = F.translate("text", _BLANKS, "")
    return rows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        "n_words",
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "case when repeats is null then 0L else cast(5 + case when size(repeats) < 2 then 0 else"
            " aggregate(sequence(0, size(repeats) - 2), 0, (a, k) -> a + least(5, repeats[k + 1] - repeats[k])) end as bigint) end"
        ).alias("n_repeat_words"),
        F.transform(
            "lines",
            lambda x: F.struct(
                F.xxhash64(F.regexp_replace(F.lower(F.btrim(x, F.lit(_BLANKS))), f"[{WS}]+", " ")).alias("line"),
                F.length(F.translate(x, _BLANKS, "")).cast("long").alias("chars"),
                F.size(F.split(F.btrim(x, F.lit(_BLANKS)), f"[{WS}]+")).cast("long").alias("words"),
            ),
        ).alias("lines"),
    )


def line_rules(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    max_docs: int = MAX_DOCS,
    share: float = SHARE,
    max_loss: float = MAX_LOSS,
    min_words: int = MIN_WORDS,
    copies: bool = True,
) -> DataFrame:
    """One row per document with its counts, the base verdict and the final one."""
    rows = materialise(_measures(docs), "measures")
    lines = rows.select("doc_id", "host", "text_hash", F.explode("lines").alias("l")).select(
        "doc_id", "host", "text_hash", "l.*"
    )
    document = "doc_id" if copies else "text_hash"
    named = rows.filter("doc_id is not null")
    common = (
        named.select("host", document, F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
        .distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > min_docs)
    )
    hosts = named.select("host", document).distinct().groupBy("host").agg(F.count("*").alias("docs"))
    limit = F.greatest(F.lit(min_docs), F.least(F.lit(max_docs), share * F.col("docs")))
    removed = materialise(common.join(small_side(hosts, 500_000), "host").filter(F.col("n") > limit).select("host", "line"), "removed")
    # Removed lines are the most frequent ones: they are met by broadcast while they are few.
    removed = small_side(removed, 500_000)
    lost = (
        lines.filter("doc_id is not null")
        .join(removed, ["host", "line"])
        .groupBy("doc_id", "text_hash")
        .agg(F.sum("chars").alias("lost_chars"), F.sum("words").alias("lost_words"), F.count("*").alias("lost_lines"))
    )
    # Repeated rows count as one document here.
    again = named.groupBy("doc_id", "text_hash").agg(F.count("*").alias("again"))
    lost = lost.join(again, ["doc_id", "text_hash"]).select(
        "doc_id", "text_hash", *(F.expr(f"{c} div again").alias(c) for c in ("lost_chars", "lost_words", "lost_lines"))
    )
    none = F.lit(0).cast("long")
    out = rows.drop("lines").join(lost, ["doc_id", "text_hash"], "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.coalesce("lost_chars", none).alias("lost_chars"),
        F.coalesce("lost_words", none).alias("lost_words"),
        F.coalesce("lost_lines", none).alias("lost_lines"),
    )
    depleted = (F.col("lost_lines") > 0) & (
        (F.col("lost_chars") > max_loss * F.col("word_chars")) | (F.col("n_words") - F.col("lost_words") < min_words)
    )
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)
