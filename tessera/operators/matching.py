"""Requirement and evidence matching: scores, decisions, rollups, traces. Specified only; scores are inputs.

Scores are integers in tenths (weight x match x credibility x 10), so thresholds
are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAD, SUPPORT = 160, 80


def decision(score10: Column) -> Column:
    return F.when(score10 >= LEAD, "lead").when(score10 >= SUPPORT, "support").otherwise("omit")


def support_type(credibility: Column) -> Column:
    return F.when(credibility.isin("A", "B", "C"), "explicit").when(credibility.isin("D", "E"), "tentative").otherwise("market_general")


def matrix(requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per (requirement, evidence) that the mapping names; an equi-join, not a product."""
    score = (F.col("weight") * F.col("match_score") * F.col("credit")).cast("long")
    return (
        requirements.join(evidence, "item_id")
        .withColumn("score10", score)
        .select("requirement_id", "evidence_id", "experience", "weight", "match_score", "credit", "score10", "confirmed", "source_id", "credibility")
    )


def multi_evidence(rows: DataFrame) -> DataFrame:
    """Per requirement and experience: best match, mean credibility before the product."""
    return rows.groupBy("requirement_id", "experience").agg(
        F.count("*").alias("n"),
        F.round(F.max("weight") * F.max("match_score") * F.sum("credit") / F.count("*") / 10.0, 4).alias("score"),
    )


def rollup(rows: DataFrame) -> DataFrame:
    """Per experience: totals, the best, and requirements of high weight that it covers."""
    covered = F.when((F.col("weight") >= 4) & (F.col("score10") >= SUPPORT), F.col("requirement_id"))
    return rows.groupBy("experience").agg(
        F.sum("score10").alias("total10"), F.max("score10").alias("best10"), F.count_distinct(covered).alias("high_covered")
    ).withColumn("decision", decision(F.col("best10")))


def best_source(rows: DataFrame) -> DataFrame:
    """The most credible source of each requirement source id, ties by id."""
    return rows.groupBy("source_id").agg(F.min_by("requirement_id", F.struct("credibility", "requirement_id")).alias("best"), F.min("credibility").alias("credibility"))


def research_confidence(rows: DataFrame) -> DataFrame:
    """By source mix: an A-level source is high, B or C medium, others low."""
    return rows.groupBy("source_id").agg(F.min("credibility").alias("c")).select(
        "source_id", F.when(F.col("c") == "A", "high").when(F.col("c").isin("B", "C"), "medium").otherwise("low").alias("confidence")
    )


def eligibility(rows: DataFrame, least: int = 1) -> DataFrame:
    """Pass or fail per experience, never averaged: all its eligibility requirements must match."""
    gates = rows.filter("eligibility")
    return gates.groupBy("experience").agg(F.bool_and(F.col("match_score") >= least).alias("eligible"))


def gaps(requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """Requirements without sufficient evidence, by kind."""
    best = evidence.groupBy("item_id").agg(
        F.max("match_score").alias("m"), F.max("credit").alias("c"), F.bool_or("confirmed").alias("ok")
    )
    kind = (
        F.when(F.col("eligibility") & (F.coalesce("m", F.lit(0)) == 0), "eligibility")
        .when(F.col("m").isNull(), "experience")
        .when(~F.col("ok"), "clarification")
        .when(F.col("c") < 6, "credibility")
        .when(F.col("m") < 3, "presentation")
    )
    return requirements.join(best, "item_id", "left").select("requirement_id", kind.alias("gap")).filter("gap is not null")


def trace(bullets: DataFrame, evidence: DataFrame, requirements: DataFrame) -> DataFrame:
    """Bullet -> evidence -> requirement -> source; evidence that is not confirmed stays out."""
    usable = evidence.filter("confirmed").select("doc_id", "evidence_id", "item_id")
    return (
        bullets.join(usable, "doc_id")
        .join(requirements.select("item_id", "requirement_id", "source_id"), "item_id")
        .select("bullet_id", F.concat_ws(" -> ", "bullet_id", "evidence_id", "requirement_id", "source_id").alias("path"))
    )


def orphans(bullets: DataFrame, traced: DataFrame) -> DataFrame:
    return bullets.join(traced.select("bullet_id").distinct(), "bullet_id", "left_anti").select("bullet_id")


def unused_evidence(rows: DataFrame, bullets: DataFrame, evidence: DataFrame, least: int = SUPPORT) -> DataFrame:
    used = bullets.join(evidence.select("doc_id", "evidence_id"), "doc_id").select("evidence_id").distinct()
    return rows.filter(F.col("score10") >= least).join(used, "evidence_id", "left_anti").select("evidence_id", "score10")


def publication_rank(df: DataFrame) -> DataFrame:
    """Authorship tier, then relevance, status and venue; the tier of corresponding authors depends on the candidate."""
    tier = (
        F.when(F.col("authorship") == "first", 1)
        .when(F.col("authorship") == "co_first", 2)
        .when((F.col("authorship") == "corresponding") & F.col("senior"), 3)
        .when(F.col("authorship") == "major", 4)
        .otherwise(5)
    )
    w = Window.partitionBy("candidate").orderBy("tier", F.col("relevance").desc(), "status", "venue", "pub_id")
    return df.withColumn("tier", tier.cast("long")).withColumn("place", F.row_number().over(w).cast("long"))


def compression_order(df: DataFrame, budget: int) -> DataFrame:
    """What is dropped first; ``kept`` while the rows that rank behind it fit into the budget."""
    w = Window.partitionBy("candidate").orderBy(F.col("drop_rank").desc(), "block_id").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum("length").over(w)).withColumn("kept", F.col("running") <= budget)


def quality_gates(df: DataFrame) -> DataFrame:
    """Length gates by language and the check for unresolved placeholders."""
    words = F.size(F.split(F.trim("text"), " ")).cast("long")
    fits = F.when(F.col("lang") == "en", words.between(450, 750)).otherwise(F.length("text").between(700, 1200))
    return df.select("doc_id", words.alias("words"), fits.alias("fits"), (~F.col("text").rlike(r"\{\{[^}]*\}\}")).alias("resolved"))


def mask_sensitive(df: DataFrame, fields: tuple[str, ...], lang: str = "lang") -> DataFrame:
    """English output hides these fields."""
    return df.withColumns({f: F.when(F.col(lang) == "en", None).otherwise(F.col(f)) for f in fields})


def missing_fields(df: DataFrame, levels: dict[str, tuple[str, ...]]) -> DataFrame:
    """Names of null fields by level."""
    out = {
        f"missing_{level}": F.array_join(F.array_compact(F.array(*(F.when(F.col(f).isNull(), f) for f in fields))), ",")
        for level, fields in levels.items()
    }
    return df.withColumns(out)
