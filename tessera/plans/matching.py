"""Queries over requirements, evidence, bullets (specified only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as H
from .catalog import query

MATRIX = """m AS (SELECT requirement_id, evidence_id, experience, weight, match_score, credit, weight * match_score * credit AS score10, confirmed, source_id, credibility
    FROM requirement JOIN evidence USING (item_id))"""
DECIDE = "CASE WHEN {0} >= 160 THEN 'lead' WHEN {0} >= 80 THEN 'support' ELSE 'omit' END"
BOTH = ("requirement", "evidence")


@query("match_matrix", f"WITH {MATRIX} SELECT requirement_id, evidence_id, score10::bigint AS score10 FROM m", *BOTH)
def _(t):
    return H.matrix(t.requirement, t.evidence).select("requirement_id", "evidence_id", "score10")


@query("match_decision", f"WITH {MATRIX} SELECT requirement_id, evidence_id, {DECIDE.format('score10')} AS decision FROM m", *BOTH)
def _(t):
    return H.matrix(t.requirement, t.evidence).select("requirement_id", "evidence_id", H.decision(F.col("score10")).alias("decision"))


@query("match_multi_evidence", f"WITH {MATRIX} SELECT requirement_id, experience, count(*) AS n, round((max(weight) * max(match_score) * sum(credit))::double / count(*) / 10.0, 4) AS score FROM m GROUP BY ALL", *BOTH)
def _(t):
    return H.multi_evidence(H.matrix(t.requirement, t.evidence))


@query("experience_rollup", f"WITH {MATRIX} SELECT experience, sum(score10)::bigint AS total10, max(score10)::bigint AS best10, count(DISTINCT CASE WHEN weight >= 4 AND score10 >= 80 THEN requirement_id END) AS high_covered, {DECIDE.format('max(score10)')} AS decision FROM m GROUP BY experience", *BOTH)
def _(t):
    return H.rollup(H.matrix(t.requirement, t.evidence))


@query("req_support_type", "SELECT requirement_id, CASE WHEN credibility IN ('A', 'B', 'C') THEN 'explicit' WHEN credibility IN ('D', 'E') THEN 'tentative' ELSE 'market_general' END AS support FROM requirement", "requirement")
def _(t):
    return t.requirement.select("requirement_id", H.support_type(F.col("credibility")).alias("support"))


@query("best_source", "SELECT source_id, arg_min(requirement_id, (credibility, requirement_id)) AS best, min(credibility) AS credibility FROM requirement GROUP BY source_id", "requirement")
def _(t):
    return H.best_source(t.requirement)


@query("research_confidence", "SELECT source_id, CASE WHEN min(credibility) = 'A' THEN 'high' WHEN min(credibility) IN ('B', 'C') THEN 'medium' ELSE 'low' END AS confidence FROM requirement GROUP BY source_id", "requirement")
def _(t):
    return H.research_confidence(t.requirement)


@query("eligibility_gate", "SELECT experience, bool_and(match_score >= 1) AS eligible FROM requirement JOIN evidence USING (item_id) WHERE eligibility GROUP BY experience", *BOTH)
def _(t):
    return H.eligibility(t.requirement.select("item_id", "eligibility").join(t.evidence, "item_id"))


@query(
    "requirement_gaps",
    """WITH b AS (SELECT item_id, max(match_score) AS m, max(credit) AS c, bool_or(confirmed) AS ok FROM evidence GROUP BY 1),
    g AS (SELECT requirement_id, CASE WHEN eligibility AND coalesce(m, 0) = 0 THEN 'eligibility' WHEN m IS NULL THEN 'experience' WHEN NOT ok THEN 'clarification' WHEN c < 6 THEN 'credibility' WHEN m < 3 THEN 'presentation' END AS gap FROM requirement LEFT JOIN b USING (item_id))
    SELECT * FROM g WHERE gap IS NOT NULL""",
    *BOTH,
)
def _(t):
    return H.gaps(t.requirement, t.evidence)


TRACE = "tr AS (SELECT bullet_id, concat_ws(' -> ', bullet_id, evidence_id, requirement_id, source_id) AS path FROM bullet JOIN evidence USING (doc_id) JOIN requirement USING (item_id) WHERE confirmed)"


@query("trace_path", f"WITH {TRACE} SELECT * FROM tr", *BOTH, "bullet")
def _(t):
    return H.trace(t.bullet, t.evidence, t.requirement)


@query("trace_orphans", f"WITH {TRACE} SELECT bullet_id FROM bullet WHERE bullet_id NOT IN (SELECT bullet_id FROM tr)", *BOTH, "bullet")
def _(t):
    return H.orphans(t.bullet, H.trace(t.bullet, t.evidence, t.requirement))


@query("unused_high_evidence", f"WITH {MATRIX} SELECT evidence_id, score10::bigint AS score10 FROM m WHERE score10 >= 80 AND evidence_id NOT IN (SELECT evidence_id FROM bullet JOIN evidence USING (doc_id))", *BOTH, "bullet")
def _(t):
    return H.unused_evidence(H.matrix(t.requirement, t.evidence), t.bullet, t.evidence)


PUBS = "SELECT p_partkey AS pub_id, p_size AS candidate, CASE p_partkey % 5 WHEN 0 THEN 'first' WHEN 1 THEN 'co_first' WHEN 2 THEN 'corresponding' WHEN 3 THEN 'major' ELSE 'other' END AS authorship, p_size % 2 = 0 AS senior, p_partkey % 7 AS relevance, p_brand AS status, p_type AS venue FROM {part}"


@query(
    "publication_rank",
    f"""WITH pubs AS ({PUBS.replace("{part}", "part")}), r AS (SELECT *, CASE WHEN authorship = 'first' THEN 1 WHEN authorship = 'co_first' THEN 2 WHEN authorship = 'corresponding' AND senior THEN 3 WHEN authorship = 'major' THEN 4 ELSE 5 END::bigint AS tier FROM pubs)
    SELECT pub_id, candidate, tier, row_number() OVER (PARTITION BY candidate ORDER BY tier, relevance DESC, status, venue, pub_id) AS place FROM r""",
)
def _(t):
    return H.publication_rank(t.spark.sql(PUBS, part=t.part)).select("pub_id", "candidate", "tier", "place")


@query(
    "compression_order",
    """WITH b AS (SELECT doc_id AS block_id, source AS candidate, doc_id % 6 + 1 AS drop_rank, n_chars AS length FROM documents)
    SELECT block_id, candidate, running, running <= 5000 AS kept FROM (SELECT *, sum(length) OVER (PARTITION BY candidate ORDER BY drop_rank DESC, block_id)::bigint AS running FROM b)""",
)
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("block_id"), F.col("source").alias("candidate"), (F.col("doc_id") % 6 + 1).alias("drop_rank"), F.col("n_chars").alias("length"))
    return H.compression_order(rows, 5000).select("block_id", "candidate", "running", "kept")


@query(
    "quality_gates",
    r"SELECT doc_id, len(string_split(trim(text), ' ')) AS words, CASE WHEN lang = 'en' THEN len(string_split(trim(text), ' ')) BETWEEN 450 AND 750 ELSE length(text) BETWEEN 700 AND 1200 END AS fits, NOT regexp_matches(text, '\{\{[^}]*\}\}') AS resolved FROM documents",
)
def _(t):
    return H.quality_gates(t.documents)


@query("mask_sensitive", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def _(t):
    lang = F.when(F.col("c_nationkey") % 2 == 0, "en").otherwise("zh")
    rows = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), lang.alias("lang"))
    return H.mask_sensitive(rows, ("name", "segment")).drop("lang")


@query("missing_fields", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'name' ELSE '' END AS missing_critical, concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'segment' END, CASE WHEN c_custkey % 5 = 0 THEN 'balance' END) AS missing_optional FROM customer")
def _(t):
    k = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.when(k % 2 != 0, F.col("c_name")).alias("name"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 5 != 0, F.col("c_acctbal")).alias("balance"))
    return H.missing_fields(rows, {"critical": ("name",), "optional": ("segment", "balance")}).select("c_custkey", "missing_critical", "missing_optional")
