"""Queries of rule layers: every customer is a case with the defaults, a layer of its nation and a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import contracts as k
from attesta.functions.evidence import lookup
from attesta.operators import rule_layers as op
from attesta.plans import bindings as b
from attesta.plans.bindings import GRAPH_SQL
from attesta.plans.registry import query

_PROFILES = {1: "medical", 2: "general_tech", 3: "journal_top", 4: "unheard"}
_PROFILE_SQL = "CASE c_custkey % 6 WHEN 1 THEN 'medical' WHEN 2 THEN 'general_tech' WHEN 3 THEN 'journal_top' WHEN 4 THEN 'unheard' END AS profile"
_CASES_SQL = f"cases AS (SELECT c_custkey AS case_key, c_nationkey AS nation, {_PROFILE_SQL} FROM customer)"


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_key"), "c_nationkey")
    cases = c.select("case_key", lookup(F.col("case_key") % 6, _PROFILES, None).alias("profile"))
    n = F.col("c_nationkey").cast("string")
    own = F.concat(
        F.lit('{"doc_minimums": {"proposal": {"min_sources": '), n, F.lit('}}, "suspect_domains_extra": ["nation'), n, F.lit('.org"], "evidence_sufficiency": {"R1": {"min_primary_sources": '), (F.col("c_nationkey") % 3).cast("string"), F.lit("}}}")
    )
    first = c.select("case_key", F.lit(0).alias("layer"), F.lit(op.default_layer()).alias("doc"))
    return op.resolve(first.unionByName(c.select("case_key", F.lit(1).alias("layer"), own.alias("doc"))), cases)


@query("ru2_rule_problems", f"WITH {_CASES_SQL} SELECT case_key, 'unknown profile unheard; available: general_tech, journal_top, medical' AS problem FROM cases WHERE profile = 'unheard'")
def ru2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)[2]


_MINIMUMS_SQL = ", ".join(f"('{t}', {s}, {n})" for t, (s, n) in k.DOC_MINIMUMS.items())


@query("ru4_minimums_by_case", f"""WITH {_CASES_SQL}, base(doc_type, s, n) AS (VALUES {_MINIMUMS_SQL})
SELECT case_key, doc_type,
  CASE profile || '/' || doc_type WHEN 'medical/paper_journal' THEN 20 WHEN 'medical/report_survey' THEN 30 WHEN 'journal_top/paper_journal' THEN 20 WHEN 'general_tech/proposal' THEN 10 WHEN 'general_tech/report_survey' THEN 15 WHEN 'general_tech/whitepaper' THEN 8
    ELSE CASE WHEN doc_type = 'proposal' THEN nation ELSE s END END::INT AS min_sources,
  CASE profile || '/' || doc_type WHEN 'medical/paper_journal' THEN 5000 WHEN 'medical/report_survey' THEN 12000 WHEN 'journal_top/paper_journal' THEN 8000 WHEN 'general_tech/proposal' THEN 4000 WHEN 'general_tech/report_survey' THEN 6000 WHEN 'general_tech/whitepaper' THEN 3000 ELSE n END::INT AS min_chars
FROM cases, base WHERE profile IS DISTINCT FROM 'unheard'""")
def ru4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, members, _ = _resolved(spark, sf_dir)
    return members.join(op.minimums(rules), "set_key").drop("set_key")


@query("u3_domains_by_case", f"""WITH {_CASES_SQL}, d AS (SELECT case_key, list_concat({list(k.SUSPECT_DOMAINS)},
  CASE WHEN profile = 'medical' THEN ['jianshu.com', 'toutiao.com', 'zhihu.com'] ELSE ['nation' || nation || '.org'] END, ['zhihu.com', 'own' || case_key % 7 || '.net']) AS l FROM cases WHERE profile IS DISTINCT FROM 'unheard')
SELECT case_key, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS domains FROM d""")
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RU3, U3: a profile's list replaces the one of the layers before, as lists do."""
    rules, members, _ = _resolved(spark, sf_dir)
    extra = members.select("case_key", F.array(F.lit("zhihu.com"), F.concat(F.lit("own"), (F.col("case_key") % 7).cast("string"), F.lit(".net"))).alias("domains"))
    return op.suspect_domains(rules, members, extra).select("case_key", F.array_join("domains", ",").alias("domains"))


@query("l3_floor_by_case", f"""WITH {GRAPH_SQL}, {_CASES_SQL}, f AS (SELECT case_key, profile, unnest(['R2', 'R3', 'R4']) AS risk FROM cases WHERE profile IS DISTINCT FROM 'unheard'),
floors AS (SELECT case_key, risk, CASE risk WHEN 'R2' THEN CASE WHEN profile = 'medical' THEN 2 ELSE 4 END WHEN 'R3' THEN CASE profile WHEN 'medical' THEN 1 WHEN 'general_tech' THEN 4 ELSE 2 END ELSE 1 END AS floor FROM f),
x AS (SELECT claim_key, source_key, risk, claim_class, coalesce(freshness, '') AS freshness, coalesce(coalesce(list_position(['A1','A2','A3','B1','B2','C1','C2','D1','D2'], authority), 10) > floor, false) AS below
  FROM evidence JOIN claims USING (claim_key) LEFT JOIN sources USING (source_key) LEFT JOIN floors USING (case_key, risk) WHERE relation <> 'contradicts'),
y AS (SELECT claim_key, source_key, below, risk IN ('R3', 'R4') AND freshness = 'superseded' AS superseded, risk IN ('R3', 'R4') AND claim_class = 'N' AND freshness <> 'current' AS stale FROM x)
SELECT * FROM y WHERE below OR superseded OR stale""")
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, members, _ = _resolved(spark, sf_dir)
    low = op.below_floor(b.claims(spark, sf_dir), b.sources(spark, sf_dir), b.evidence(spark, sf_dir), members, op.floors(rules))
    return low.select("claim_key", "source_key", "below", "superseded", "stale")


_TIERS_SQL = ", ".join(f"('{r}', {p}, {i}, {live}, {c})" for r, (p, i, live, c) in k.TIERS.items())


@query("j2_needs_by_case", f"""WITH claims AS (SELECT o_orderkey AS claim_key, o_custkey AS case_key, 'R' || (5 - substr(o_orderpriority, 1, 1)::INT) AS risk FROM orders), {_CASES_SQL}, base(risk, p, i, live, c) AS (VALUES {_TIERS_SQL}),
x AS (SELECT claim_key, CASE WHEN known THEN CASE WHEN risk = 'R1' THEN nation % 3 ELSE p END ELSE 0 END AS p, CASE WHEN known THEN i ELSE 1 END AS i, known AND live AS live, known AND c AS c
  FROM (SELECT *, profile IS DISTINCT FROM 'unheard' AND case_key IN (SELECT case_key FROM cases) AS known FROM claims LEFT JOIN cases USING (case_key) LEFT JOIN base USING (risk)))
SELECT claim_key, ceil(p * 1.5)::INT AS need_primary, ceil(i * 1.5)::INT AS need_independent, coalesce(live, false) AS need_live, coalesce(c, false) AS need_coverage FROM x""")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What conservative review asks of each claim; a case without rules has the default of an unknown risk."""
    rules, members, _ = _resolved(spark, sf_dir)
    d = op.sufficiency_needs(b.claims(spark, sf_dir), members, op.tiers(rules), k.REVIEW_MODES["conservative"][0])
    return d.select("claim_key", "need_primary", "need_independent", "need_live", "need_coverage")
