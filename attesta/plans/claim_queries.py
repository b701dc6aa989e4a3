"""Queries over the claim-evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.operators import claims as op
from attesta.operators.claims import GRADE_SQL, SCORE_SQL, STATUS_SQL
from attesta.plans import bindings as b
from attesta.plans.bindings import CLAIMS_SQL, EVIDENCE_SQL, GRAPH_SQL
from attesta.plans.registry import query

_POINTS = """CASE authority WHEN 'A1' THEN 10 WHEN 'A2' THEN 9 WHEN 'A3' THEN 8 WHEN 'B1' THEN 7 WHEN 'B2' THEN 6 WHEN 'C1' THEN 5 WHEN 'C2' THEN 4 WHEN 'D1' THEN 3 WHEN 'D2' THEN 2 ELSE 4 END"""
_PRIMARY = "coalesce(s.authority IN ('A1','A2','A3','B1','B2'), false)"
STATISTICS_SQL = f"""{GRAPH_SQL}, sums AS (
  SELECT claim_key, count(*) FILTER (e.source_id LIKE 'S%') AS independent, count(*) FILTER ({_PRIMARY}) AS primary_sources, bool_or({_PRIMARY} AND freshness = 'current') AS current_primary,
    count(*) FILTER (relation <> 'contradicts') AS n_support, count(*) FILTER (relation = 'contradicts') AS n_against, count(*) FILTER (relation = 'context_only') AS n_context,
    sum(CASE WHEN relation <> 'contradicts' THEN {_POINTS} ELSE 0 END) AS t_authority,
    sum(CASE WHEN relation <> 'contradicts' THEN CASE support_level WHEN 'direct' THEN 10 WHEN 'strong_inference' THEN 8 WHEN 'weak_inference' THEN 5 ELSE 3 END ELSE 0 END) AS t_level,
    sum(CASE WHEN relation <> 'contradicts' THEN CASE freshness WHEN 'current' THEN 10 WHEN 'recent' THEN 7 WHEN 'historical' THEN 4 WHEN 'superseded' THEN 1 ELSE 3 END ELSE 0 END) AS t_freshness,
    count(*) FILTER (relation <> 'contradicts' AND (located OR url IS NOT NULL)) AS n_traceable, count(*) FILTER (relation <> 'contradicts' AND located) AS n_located
  FROM evidence e LEFT JOIN sources s USING (source_key) GROUP BY claim_key
), stats AS (
  SELECT c.*, coalesce(independent, 0) AS independent, coalesce(primary_sources, 0) AS primary_sources, coalesce(current_primary, false) AS current_primary, coalesce(n_support, 0) AS n_support,
    coalesce(n_against, 0) AS n_against, coalesce(n_context, 0) AS n_context, coalesce(t_authority, 0) AS t_authority, coalesce(t_level, 0) AS t_level, coalesce(t_freshness, 0) AS t_freshness,
    coalesce(n_traceable, 0) AS n_traceable, coalesce(n_located, 0) AS n_located
  FROM claims c LEFT JOIN sums USING (claim_key)
), scored AS (SELECT *, {SCORE_SQL} AS score FROM stats), graded AS (SELECT *, {GRADE_SQL} AS grade FROM scored)"""


def _sufficiency_sql(primary: dict, independent: dict, live: str) -> str:
    case = lambda t, other: "CASE risk " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in t.items()) + f" ELSE {other} END"
    return f"""WITH {STATISTICS_SQL}, judged AS (
  SELECT *, concat_ws(',', CASE WHEN primary_sources < {case(primary, 0)} THEN 'primary' END, CASE WHEN independent < {case(independent, 1)} THEN 'independent' END,
    CASE WHEN {live} AND claim_class = 'N' AND NOT current_primary THEN 'current' END, CASE WHEN {live} AND claim_class <> 'N' AND verification_mode <> 'live' THEN 'live' END,
    CASE WHEN risk IN ('R2', 'R3', 'R4') AND NOT covered THEN 'coverage' END) AS reasons FROM graded)
SELECT claim_id, risk, claim_class, independent, primary_sources, current_primary, covered, reasons, reasons = '' AS passed, score, grade FROM judged"""


_OUT = ("claim_id", "risk", "claim_class", "independent", "primary_sources", "current_primary", "covered", "reasons", "passed", "score", "grade")
_SQL = {
    "balanced": _sufficiency_sql({"R2": 1, "R3": 1, "R4": 2}, {"R0": 0, "R1": 1, "R2": 2, "R3": 2, "R4": 2}, "risk IN ('R3', 'R4')"),
    "conservative": _sufficiency_sql({"R2": 2, "R3": 2, "R4": 3}, {"R0": 0, "R1": 2, "R2": 3, "R3": 3, "R4": 3}, "true"),
}


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return b.claims(spark, sf_dir), b.sources(spark, sf_dir), b.evidence(spark, sf_dir)


@query("g4", _SQL["balanced"])
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sufficiency(*_graph(spark, sf_dir)).select(*_OUT)


@query("g4_sufficiency_conservative", _SQL["conservative"])
def g4_conservative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sufficiency(*_graph(spark, sf_dir), mode="conservative").select(*_OUT)


@query("g4_sufficiency_exploratory", _SQL["balanced"])
def g4_exploratory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its multiplier rounds up to the balanced thresholds."""
    return op.sufficiency(*_graph(spark, sf_dir), mode="exploratory").select(*_OUT)


@query("f15_incremental_changed", _SQL["balanced"] + " WHERE claim_id IN (SELECT 'C-' || l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01')")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, sources, evidence = _graph(spark, sf_dir)
    changed = b.table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP '2000-01-01'").select(F.concat(F.lit("C-"), F.col("l_orderkey").cast("string")).alias("claim_id"))
    return op.recheck(claims, sources, evidence, changed).select(*_OUT)


@query("a10_totals", f"WITH x AS ({_SQL['balanced']}) SELECT risk, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) AS claims FROM x GROUP BY risk")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g4(spark, sf_dir).groupBy("risk").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("claims"))


@query("a7_evidence_score", f"WITH {STATISTICS_SQL} SELECT claim_id, n_support, score, grade FROM graded")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, sources, evidence = _graph(spark, sf_dir)
    d = op.claim_statistics(claims, op.edges_with_sources(evidence, sources)).withColumn("score", op.score_of())
    return d.select("claim_id", "n_support", "score", op.grade_of(F.col("score")).alias("grade"))


@query("a8_grade_histogram", f"WITH {STATISTICS_SQL} SELECT grade, count(*) AS claims FROM graded GROUP BY grade")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a7(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("claims"))


@query("a2_independent_primary", f"WITH {STATISTICS_SQL} SELECT claim_id, independent, primary_sources FROM stats")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, sources, evidence = _graph(spark, sf_dir)
    return op.claim_statistics(claims, op.edges_with_sources(evidence, sources)).select("claim_id", "independent", "primary_sources")


@query("a3_current_primary", f"WITH {STATISTICS_SQL} SELECT claim_id, current_primary FROM stats")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, sources, evidence = _graph(spark, sf_dir)
    return op.claim_statistics(claims, op.edges_with_sources(evidence, sources)).select("claim_id", "current_primary")


@query("a12_balance", f"""WITH {STATISTICS_SQL} SELECT claim_id, CASE WHEN n_against > n_support - n_context THEN '−' WHEN n_support > n_context AND n_against = 0 THEN '+'
  WHEN n_support > n_context AND n_against > 0 THEN '±' WHEN n_context > 0 THEN '=' ELSE '?' END AS mark FROM stats""")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.balance(*_graph(spark, sf_dir)).select("claim_id", "mark")


_AUDIT = f"""{CLAIMS_SQL}, {EVIDENCE_SQL}, audited AS (
  SELECT claim_id, risk IN ('R3', 'R4') OR claim_class = 'N' AS high_risk, count(e.source_key) AS n_support, count(e.source_key) FILTER (NOT located) AS n_lost,
    coalesce(string_agg(CASE WHEN NOT located THEN e.source_key::VARCHAR END, ',' ORDER BY e.source_key), '') AS lost
  FROM claims c LEFT JOIN (SELECT * FROM evidence WHERE relation <> 'contradicts') e USING (claim_key) GROUP BY ALL)"""


@query("a11_auditability", f"WITH {_AUDIT} SELECT claim_id, high_risk, n_support, n_lost::INT AS n_lost, lost, n_lost = 0 AS auditable FROM audited")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, _, evidence = _graph(spark, sf_dir)
    return op.auditability(claims, evidence).select("claim_id", "high_risk", "n_support", "n_lost", F.array_join("lost", ",").alias("lost"), "auditable")


@query("g9_auditability", f"""WITH {_AUDIT}, s AS (SELECT count(*) AS claims, sum(n_support)::BIGINT AS edges, sum(n_lost)::BIGINT AS lost, count(*) FILTER (high_risk) AS high_risk, count(*) FILTER (high_risk AND n_lost > 0) AS high_risk_failing FROM audited)
SELECT *, CASE WHEN edges > 0 THEN round_even((edges - lost)::DOUBLE / edges, 3) ELSE 1.0 END AS ratio, high_risk_failing = 0 AS passed FROM s""")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, _, evidence = _graph(spark, sf_dir)
    return op.audit_summary(op.auditability(claims, evidence))


@query("f16_high_risk", f"WITH {CLAIMS_SQL} SELECT claim_id FROM claims WHERE risk IN ('R3', 'R4') OR claim_class = 'N'")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.claims(spark, sf_dir).where(op.high_risk()).select("claim_id")


@query("f17_locator", f"WITH {EVIDENCE_SQL} SELECT claim_key, source_key, located FROM evidence")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.functions.evidence import located

    e = b.evidence(spark, sf_dir)
    return e.select("claim_key", "source_key", located(e).alias("located"))


@query("j1_edge_source_left", f"WITH {GRAPH_SQL} SELECT claim_key, source_key, coalesce(authority, '') AS authority, coalesce(freshness, '') AS freshness, coalesce(url, '') AS url, s.source_id IS NOT NULL AS known FROM evidence LEFT JOIN sources s USING (source_key)")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.edges_with_sources(b.evidence(spark, sf_dir), b.sources(spark, sf_dir)).select("claim_key", "source_key", "authority", "freshness", "url", "known")


@query("j2_tier_lookup", f"WITH {CLAIMS_SQL} SELECT claim_id, CASE risk WHEN 'R2' THEN 1 WHEN 'R3' THEN 1 WHEN 'R4' THEN 2 ELSE 0 END AS min_primary, CASE risk WHEN 'R0' THEN 0 WHEN 'R1' THEN 1 ELSE 2 END AS min_independent, risk IN ('R3', 'R4') AS live, risk IN ('R2', 'R3', 'R4') AS coverage FROM claims")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.claims(spark, sf_dir).select("claim_id", *[op.tier_value(i).alias(x) for i, x in enumerate(("min_primary", "min_independent", "live", "coverage"))])


@query("p12_relation", f"WITH {EVIDENCE_SQL} SELECT support_level, relation, count(*) AS edges FROM evidence GROUP BY ALL")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.evidence(spark, sf_dir).groupBy("support_level", "relation").agg(F.count("*").alias("edges"))


@query("f19_support_edges", f"WITH {EVIDENCE_SQL} SELECT claim_key, source_key FROM evidence WHERE relation <> 'contradicts'")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.evidence(spark, sf_dir).where(F.col("relation") != "contradicts").select("claim_key", "source_key")


@query("l1_needs_source", f"WITH {CLAIMS_SQL} SELECT claim_id FROM claims WHERE claim_class IN ('E', 'M', 'N', 'L') AND claim_key NOT IN (SELECT l_orderkey FROM lineitem)")
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.unsupported_claims(b.claims(spark, sf_dir), b.evidence(spark, sf_dir)).select("claim_id")


@query("l2_status", f"""WITH {CLAIMS_SQL}, {EVIDENCE_SQL}, x AS (SELECT claim_id, count(*) FILTER (support_level = 'direct') AS direct, count(*) FILTER (support_level IN ('strong_inference', 'weak_inference')) AS inferred,
  count(*) FILTER (support_level = 'contradictory') AS against FROM claims LEFT JOIN evidence USING (claim_key) GROUP BY claim_id) SELECT claim_id, {STATUS_SQL} AS status FROM x""")
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.derived_status(b.claims(spark, sf_dir), b.evidence(spark, sf_dir)).select("claim_id", "status")


@query("l3_authority_floor", f"""WITH {GRAPH_SQL}, x AS (SELECT claim_key, source_key, risk, claim_class, coalesce(freshness, '') AS freshness,
  coalesce(list_position(['A1','A2','A3','B1','B2','C1','C2','D1','D2'], authority) - 1, 98) > CASE risk WHEN 'R2' THEN 3 WHEN 'R3' THEN 1 WHEN 'R4' THEN 0 ELSE 99 END AS below
  FROM evidence JOIN claims USING (claim_key) LEFT JOIN sources USING (source_key) WHERE relation <> 'contradicts'),
y AS (SELECT claim_key, source_key, below, risk IN ('R3', 'R4') AND freshness = 'superseded' AS superseded, risk IN ('R3', 'R4') AND claim_class = 'N' AND freshness <> 'current' AS stale FROM x)
SELECT * FROM y WHERE below OR superseded OR stale""")
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.below_floor(*_graph(spark, sf_dir)).select("claim_key", "source_key", "below", "superseded", "stale")


@query("l9_source_quality", f"WITH {GRAPH_SQL} SELECT substr(authority, 1, 1) AS level, count(*) AS sources FROM sources GROUP BY ALL")
def l9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.sources(spark, sf_dir).groupBy(F.substring("authority", 1, 1).alias("level")).agg(F.count("*").alias("sources"))


@query("l11_final_gate", f"""WITH x AS ({_SQL['balanced']}), {_AUDIT} SELECT x.claim_id, x.passed AS sufficient, n_lost = 0 OR NOT high_risk AS auditable, x.passed AND (n_lost = 0 OR NOT high_risk) AS released FROM x JOIN audited USING (claim_id)""")
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim is released if every gate passes."""
    claims, sources, evidence = _graph(spark, sf_dir)
    a = op.auditability(claims, evidence).select("claim_id", (F.col("auditable") | ~F.col("high_risk")).alias("auditable"))
    s = op.sufficiency(claims, sources, evidence).select("claim_id", F.col("passed").alias("sufficient"))
    return s.join(a, "claim_id").withColumn("released", F.col("sufficient") & F.col("auditable"))


@query("p15_edges", f"WITH {EVIDENCE_SQL} SELECT 'C-' || claim_key AS claim_id, source_id, support_level, relation, page, section, row_number() OVER (PARTITION BY claim_key ORDER BY source_key) - 1 AS pos FROM evidence")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a map by source, taken apart again: what the map reader does for every claim."""
    entry = F.struct("source_key", "source_id", "support_level", "page", "section")
    maps = b.evidence(spark, sf_dir).groupBy("claim_key").agg(F.sort_array(F.collect_list(entry)).alias("m"))
    maps = maps.select("claim_key", F.map_from_arrays(F.transform("m", lambda x: x["source_id"]), F.transform("m", lambda x: F.struct(x["support_level"], x["page"], x["section"]))).alias("levels"))
    e = maps.select("claim_key", F.posexplode(F.map_entries("levels")).alias("pos", "e"))
    from attesta.functions.evidence import relation_of

    return e.select(F.concat(F.lit("C-"), F.col("claim_key").cast("string")).alias("claim_id"), F.col("e.key").alias("source_id"), F.col("e.value.support_level").alias("support_level"), relation_of(F.col("e.value.support_level")).alias("relation"), F.col("e.value.page").alias("page"), F.col("e.value.section").alias("section"), F.col("pos").cast("long").alias("pos"))


@query("p16_claims_by_source", f"""WITH {EVIDENCE_SQL} SELECT source_id, count(*) AS n, string_agg('C-' || claim_key || ':' || support_level, ',' ORDER BY claim_key) AS claims FROM evidence GROUP BY source_id""")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.claims_by_source(b.evidence(spark, sf_dir)).select("source_id", "n", F.array_join(F.transform("claims", lambda x: F.concat(F.lit("C-"), x["claim_key"].cast("string"), F.lit(":"), x["support_level"])), ",").alias("claims"))


@query("p11_claim_ids", "SELECT o_custkey AS case_key, o_orderkey AS claim_key, 'C-' || lpad((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::VARCHAR, 3, '0') AS claim_id FROM orders")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("case_key").orderBy("claim_key"))
    return b.claims(spark, sf_dir).select("case_key", "claim_key", F.format_string("C-%03d", place).alias("claim_id"))
