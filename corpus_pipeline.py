"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes
it as Parquet into the shared folder and rereads it as the next stage's ``docs``.
All stages but the last return the columns of their input. ``ORACLE_SQL`` is None:
a Viterbi decoder, XXH64 fingerprints and a tokenizer are not expressible in SQL;
the stages are tested against plain Python versions instead.

Edge cases: an empty table passes through all stages and packs into no rows; rows
without ``doc_id`` cannot be named by a group, a benchmark hit or a span of their
own and are kept; rows that share a ``doc_id`` are judged each by its text, and of those
in one group of near duplicates one stays; additional columns are carried along unread, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, packing, pii, simhash, toxicity
from tessera.llm.common import discard, intermediate, materialise, shared_dir, small_side, sweep, table
from tessera.llm.queries import word_tokenizer

ORACLE_SQL = None
_OWN = "_tessera_"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores at least one half go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, model, f"{_OWN}score")
    return scored.filter(F.col(f"{_OWN}score") < 0.5).select(*docs.columns)


def _repeated_ids(df: DataFrame) -> DataFrame:
    """Ids that several rows have, which then name no row."""
    again = df.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(f"{_OWN}id")).count()
    return materialise(again.filter("count > 1").select(f"{_OWN}id"), "repeated")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the smallest id stays.

    Rows that share an id are told apart by their fingerprints; of those in one component
    the row that sorts first stays.
    """
    found = materialise(simhash.near_duplicates(docs, groups=True), "components")
    key = F.col("doc_id").cast("long")
    again = _repeated_ids(found)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(f"{_OWN}id")).distinct()
    if again.isEmpty():
        return docs.join(small_side(gone), key == F.col(f"{_OWN}id"), "left_anti")
    kept = docs.join(small_side(gone.unionByName(again).distinct()), key == F.col(f"{_OWN}id"), "left_anti")
    # A row's own number stands for its id while its fingerprint is taken.
    number, row = f"{_OWN}number", f"{_OWN}row"
    rows = docs.join(again, key == F.col(f"{_OWN}id"), "left_semi")
    rows = materialise(rows.select(F.xxhash64("doc_id", "text").alias(number), F.struct(*docs.columns).alias(row)), "rows")
    prints = simhash.fingerprints(rows.select(F.col(number).alias("doc_id"), F.col(f"{row}.text").alias("text"))).distinct()
    prints = prints.select(F.col("doc_id").alias(number), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))
    heads = found.filter("doc_id = component_id").select(F.col("doc_id").alias(f"{_OWN}id"), "fingerprint", "group").distinct()
    same = (F.col(f"{row}.doc_id").cast("long") == F.col(f"{_OWN}id")) & (prints["fingerprint"] == heads["fingerprint"])
    stay = rows.join(prints, number).join(heads, same).groupBy(f"{_OWN}id", "group").agg(F.min_by(row, F.to_json(row)).alias(row))
    return kept.unionByName(stay.select(f"{row}.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go.

    Rows that share an id are judged each by its own text, under a number of its own.
    """
    again, name = _repeated_ids(docs), F.col("doc_id").cast("long")
    told = docs
    if not again.isEmpty():
        told = docs.join(again, name == F.col(f"{_OWN}id"), "left")
        name = F.when(F.col(f"{_OWN}id").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(name)
    # The stage's columns and the name under which a row is judged.
    told = told.select(F.struct(*docs.columns).alias(f"{_OWN}row"), name.alias("doc_id"), "text")
    hits = decontamination.contaminated(told.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    gone = materialise(hits.select(F.col("doc_id").alias(f"{_OWN}id")).distinct(), "contaminated")
    return told.join(small_side(gone), F.col("doc_id") == F.col(f"{_OWN}id"), "left_anti").select(f"{_OWN}row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes ``<kind>``; ``n_chars`` follows where the text changes."""
    found = pii.extract(docs)
    names = {"doc_id": f"{_OWN}id", "text_hash": f"{_OWN}hash"}
    more = found.filter("more is not null").select("doc_id", "text_hash", "more").dropDuplicates(["doc_id", "text_hash"])
    more = materialise(more.withColumnsRenamed(names), "more")
    n_spans = more.agg(F.coalesce(F.sum(F.size("more")), F.lit(0))).first()[0]
    # Base spans are found again beside the text, which is cheaper than moving texts.
    rows = pii.base_spans(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), "_row")
    rows = rows.withColumn("text_hash", F.xxhash64("doc_id", "text"))
    if not n_spans:
        rows = rows.withColumn("more", F.lit(None).cast(more.schema["more"].dataType))
    else:
        # Some 40 bytes a span are broadcast, up to a million spans.
        same = F.col("doc_id").eqNullSafe(F.col(f"{_OWN}id")) & (F.col("text_hash") == F.col(f"{_OWN}hash"))
        rows = rows.join(F.broadcast(more) if n_spans <= 1_000_000 else more, same, "left")
    rows = rows.withColumn("_spans", F.array_sort(F.concat(pii.base_array(), F.coalesce("more", F.array().cast(more.schema["more"].dataType)))))
    rows = rows.withColumn("_hit", F.size("_spans") > 0).withColumn("_masked", F.when(F.col("_hit"), pii.masked(F.col("text"), F.col("_spans"))))
    out = []
    for c in docs.columns:
        value = F.col("_row").getField(c)
        if c == "text":
            value = F.when(F.col("_hit"), F.col("_masked")).otherwise(value)
        elif c == "n_chars":
            value = F.when(F.col("_hit"), F.length("_masked").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return rows.select(*out)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    # A smaller cache: executors still hold what the stages before it took.
    return packing.pack(docs, word_tokenizer(), entries=100_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        before = intermediate()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        # Nothing reads what the stage worked with any more, nor its input.
        sweep(spark, before)
        if k:
            discard(spark, f"{folder}/{k - 1}")
    return docs
