"""Queries of reports, gates and review rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.evidence import lookup
from attesta.operators import brief as op
from attesta.operators import claims as claims_op
from attesta.plans import bindings as b
from attesta.plans.bindings import EVIDENCE_SQL
from attesta.plans.claim_queries import _SQL, STATISTICS_SQL, _graph
from attesta.plans.registry import query

_LABEL = "CASE WHEN e.source_id LIKE 'S%' THEN '' ELSE 'S' END || e.source_id || '/' || coalesce(authority, '?') || '/' || coalesce(freshness, '?') || '/' || CASE support_level WHEN 'contradictory' THEN 'contradicts' WHEN 'context_only' THEN 'context_only' WHEN 'unsupported' THEN 'unsupported' ELSE 'supports' END || '/' || support_level || CASE WHEN located THEN ' @' || concat_ws(' ', 'page=' || nullif(page, 0), 'section=' || section) ELSE '' END"
_MARK = "CASE WHEN n_against > n_support - n_context THEN '−' WHEN n_support > n_context AND n_against = 0 THEN '+' WHEN n_support > n_context AND n_against > 0 THEN '±' WHEN n_context > 0 THEN '=' ELSE '?' END"
_TEXT, _STATE, _SURE = "('Claim ' || claim_key || repeat(' and more', (claim_key % 9)::INT))", "CASE claim_key % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'inferred' WHEN 2 THEN '' END", "CASE claim_key % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END"
_LINES = f"""{STATISTICS_SQL}, lines AS (SELECT *, coalesce(nullif({_STATE}, ''), '-') AS state, coalesce(CASE WHEN claim_key % 5 = 0 THEN 'open' END, {_STATE}, '') AS verdict, coalesce({_SURE}, 'medium') AS sure, {_TEXT} AS said, {_MARK} AS mark,
  '| ' || claim_id || ' | ' || claim_class || ' | ' || risk || ' | ' || substr({_TEXT}, 1, 60) || ' | ' || (n_support - n_context) || ' | ' || n_against || ' | ' || coalesce(nullif({_STATE}, ''), '-') || ' | ' || {_MARK} || ' | ' || coalesce({_SURE}, 'medium') || ' | ' || printf('%.1f', score) || '/' || grade || ' |' AS line FROM graded),
labels AS (SELECT claim_key, source_key, support_level, {_LABEL} AS label FROM evidence e LEFT JOIN sources USING (source_key)),
lists AS (SELECT claim_key, coalesce(string_agg(CASE WHEN support_level NOT IN ('contradictory', 'context_only') THEN label END, '；' ORDER BY source_key), '') AS support,
  coalesce(string_agg(CASE WHEN support_level = 'contradictory' THEN label END, '；' ORDER BY source_key), '') AS against, coalesce(string_agg(CASE WHEN support_level = 'context_only' THEN label END, '；' ORDER BY source_key), '') AS context FROM labels GROUP BY claim_key)"""


def _told(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph, its claims with texts, and some with a status, a verdict and a confidence."""
    claims, sources, evidence = _graph(spark, sf_dir)
    key = F.col("claim_key")
    text = F.concat(F.lit("Claim "), key.cast("string"), F.repeat(F.lit(" and more"), (key % 9).cast("int")))
    said = {"claim_text": text, "evidence_status": lookup(key % 4, {0: "supported", 1: "inferred", 2: " "}, None), "verdict": F.when(key % 5 == 0, "open"), "confidence": lookup(key % 3, {0: "high", 1: "low"}, None)}
    return claims.withColumns(said), sources, evidence


@query("sk9_brief_rows", f"WITH {_LINES} SELECT claim_id, line, verdict, coalesce(support, '') AS support, coalesce(against, '') AS against, coalesce(context, '') AS context FROM lines LEFT JOIN lists USING (claim_key)")
def sk9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, P21 too."""
    return op.brief_rows(*_told(spark, sf_dir)).select("claim_id", "line", "verdict", "support", "against", "context")


_TWO = "chr(10) || chr(10)"
_HEAD = op.HEAD.format(on="2026-01-01", mode="balanced", multiplier=1.0, profile="default", columns=" | ".join(op.COLUMNS), rules=" | ".join("---" for _ in op.COLUMNS))


@query("g12_evidence_brief", f"""WITH judged_ AS ({_SQL['balanced']}), {_LINES}, d AS (SELECT l.*, j.passed, '### ' || l.claim_id || ' [' || l.risk || '/' || l.claim_class || '] ' || said || {_TWO} || concat_ws({_TWO}, CASE WHEN support <> '' THEN '- 支持：' || support END, CASE WHEN against <> '' THEN '- 反证：' || against END, CASE WHEN context <> '' THEN '- 背景：' || context END,
    '- 状态/判决：' || state || ' / ' || verdict || ' | 平衡：' || mark || ' | 置信度：' || sure, '- Evidence Score：**' || printf('%.1f', l.score) || '（' || l.grade || '）**（{op.WEIGHTS}）',
    CASE WHEN j.passed THEN '- 充分性：✅ 达标（balanced，乘数 1）' ELSE '- 充分性：❌ 不足（balanced，乘数 1）：' || {_TWO} || array_to_string(list_transform(string_split(j.reasons, ','), lambda x: '    - ' || trim(x)), {_TWO}) END) AS detail
  FROM lines l LEFT JOIN lists USING (claim_key) JOIN judged_ j ON j.claim_id = l.claim_id)
SELECT case_key, '{_HEAD}' || string_agg(line, chr(10) ORDER BY claim_key) || {_TWO} || '证据充分性：**' || count(*) FILTER (passed) || '/' || count(*) || '** claim 达标。' || {_TWO} || '## 逐条详情' || {_TWO} || string_agg(detail, {_TWO} ORDER BY claim_key) || '{op.FOOT}' AS brief FROM d GROUP BY case_key""")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.brief(op.brief_rows(*_told(spark, sf_dir)), "2026-01-01")


@query("g10_stage_gates", """WITH x AS (SELECT p_partkey AS k FROM part) SELECT k AS case_key, concat_ws(',', CASE WHEN k % 2 = 0 THEN '0' END, CASE WHEN k % 3 = 0 THEN '3a' END, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN '3b' END, CASE WHEN k % 5 = 0 THEN '3c' END, CASE WHEN k % 7 = 0 THEN '7' END) AS missing, k % 2 <> 0 AND k % 3 <> 0 AND k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AS passed FROM x""")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F27 too: some cases have a source without access status, some no source."""
    names = ["02_raw_sources.json", "03_audit_report.md", "04_validated_sources.json", "06_evidence_map.json", "07_honest_assessment.md", "08_初稿.md", "10_review.md"]
    k = F.col("p_partkey")
    more = [F.when(k % 2 != 0, "00_topic.md"), F.when(k % 3 != 0, "reference_files/a.pdf"), F.lit("pdf_text/a.txt"), F.when(k % 7 != 0, "11_定稿.md")]
    p = b.table(spark, sf_dir, "part")
    files = p.select(k.alias("case_key"), F.explode(F.array_compact(F.array(*[F.lit(n) for n in names], *more))).alias("path"))
    corpus = p.where(k % 13 != 0).select(k.alias("case_key"), F.explode(F.array(F.lit("confirmed"), F.when(k % 11 == 0, " ").otherwise("unavailable"))).alias("access_status"))
    return op.stage_gates(files.withColumn("bytes", F.when((F.col("path") == "pdf_text/a.txt") & (F.col("case_key") % 5 == 0), 0).otherwise(10)), corpus)


@query("g16_golden", """WITH x AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'manual' WHEN s_suppkey % 7 = 0 THEN 'error' WHEN s_suppkey % 4 = 0 THEN 'failed' ELSE 'passed' END AS status FROM supplier)
SELECT count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'manual') AS manual, string_agg('| ' || lpad(k::VARCHAR, 9, '0') || ' | ' || status || ' |', chr(10) ORDER BY k) AS lines, false AS gate FROM x""")
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK10 too: two checks a case, of which the worse counts."""
    key = F.col("s_suppkey")
    s = b.table(spark, sf_dir, "supplier").select(F.lpad(key.cast("string"), 9, "0").alias("case_id"), key.alias("k"))
    cases = s.select("case_id", (F.col("k") % 5 == 0).alias("manual"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("check"), F.lit("pass").alias("expected"))
    results = s.select("case_id", F.explode(F.array(F.lit("a"), F.when(F.col("k") % 7 != 0, "b"))).alias("check"), F.when(F.col("k") % 4 == 0, "fail").otherwise("pass").alias("actual")).where("check IS NOT NULL")
    return op.golden_summary(op.golden(cases, results))


_STATUS = ("downloaded", "exists", "not_pdf", "failed", "blocked_ssrf", "dry_run")


@query("g15_download_run", "WITH x AS (SELECT l_orderkey AS run, l_suppkey % 6 AS s FROM lineitem) SELECT run, count(*) FILTER (s = 0) AS downloaded, count(*) FILTER (s = 1) AS exists, count(*) FILTER (s = 2) AS not_pdf, count(*) FILTER (s = 3) AS failed, count(*) FILTER (s = 4) AS blocked, count(*) FILTER (s IN (3, 4)) = 0 AS passed FROM x GROUP BY run")
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), lookup(F.col("l_suppkey") % 6, dict(enumerate(_STATUS)), "").alias("status"))
    return op.download_summary(rows)


@query("a19_gap_items", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END::INT AS n FROM part")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lookup(F.col("p_partkey") % 4, {0: '{"global_gaps":[1,2],"evidence_gaps":[1]}', 1: '{"unsupported_but_needed_claims":["x"]}', 2: '{"evidence_gaps":[1,2,3]}'}, "{}")
    return b.table(spark, sf_dir, "part").select("p_partkey", op.gap_items(raw).alias("n"))


@query("p20_prompt_rules", "SELECT p_partkey, 'a: ' || p_name || ';b: ' || p_brand || ';forbid/x: ' || p_type AS rules FROM part")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.create_map(F.lit("b"), F.concat(F.col("p_brand"), F.lit(" ")), F.lit("c"), F.lit(" "), F.lit("a"), F.col("p_name"))
    forbidden = F.array(F.struct(F.lit("x").alias("id"), F.col("p_type").alias("description")))
    return b.table(spark, sf_dir, "part").select("p_partkey", F.array_join(op.prompt_rules(rules, forbidden), ";").alias("rules"))


@query("u4_required_keys", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'title' ELSE '' END AS missing FROM part")
def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC15 too: keys that a chart's data lack."""
    raw = F.when(F.col("p_partkey") % 3 == 0, '{"labels":[1],"values":[2]}').otherwise('{"labels":[1],"values":[2],"title":"t"}')
    need = F.array(*[F.lit(x) for x in ("title", "labels", "values")])
    return b.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_except(need, F.json_object_keys(raw)), ",").alias("missing"))


@query("u5_problem_union", "SELECT 'claim' AS kind, count(*) AS n FROM orders WHERE o_custkey % 7 = 0 UNION ALL SELECT 'source', count(*) FROM part WHERE p_partkey % 11 = 0")
def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = b.table(spark, sf_dir, "orders").where("o_custkey % 7 = 0").select(F.lit("claim").alias("kind"))
    return a.unionByName(b.table(spark, sf_dir, "part").where("p_partkey % 11 = 0").select(F.lit("source").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("w9_last_heading", "SELECT l_orderkey AS doc_id, arg_max(l_partkey, l_linenumber * 10000000 + l_partkey) AS last FROM lineitem GROUP BY l_orderkey")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max_by("l_partkey", F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("last"))


@query("t5_best_title", "SELECT l_orderkey AS doc_id, p_name AS title FROM (SELECT l_orderkey, p_name, count(*) >= 2 AS rep FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY rep DESC, length(p_name) DESC, p_name DESC) = 1")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F28 too: of a document's candidates the one that is repeated, then the longest."""
    p = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    c = b.table(spark, sf_dir, "lineitem").join(p, "l_partkey").groupBy("l_orderkey", "p_name").agg((F.count("*") >= 2).alias("rep"))
    best = F.max(F.struct("rep", F.length("p_name").alias("n"), "p_name"))
    return c.groupBy(F.col("l_orderkey").alias("doc_id")).agg(best.alias("x")).select("doc_id", F.col("x.p_name").alias("title"))


@query("j7_manifest_source", "SELECT l_orderkey, l_partkey, coalesce(p_name, '') AS title FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 13 <> 0")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.sources(spark, sf_dir).select(F.col("source_key").alias("l_partkey"), "title")
    return b.table(spark, sf_dir, "lineitem").join(s, "l_partkey", "left").select("l_orderkey", "l_partkey", F.coalesce("title", F.lit("")).alias("title"))


@query("j14_manual_scores", """SELECT o_orderkey AS case_id, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN 'passed' ELSE 'failed' END
  WHEN o_custkey % 3 = 0 THEN 'manual' WHEN o_orderstatus = 'F' THEN 'passed' ELSE 'failed' END AS status FROM orders""")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the cases is for people to judge; they scored some of them, and some that aren't theirs."""
    key = F.col("o_orderkey")
    o = b.table(spark, sf_dir, "orders").select(key.alias("case_id"), (F.col("o_custkey") % 3 == 0).alias("manual"), F.lit("state").alias("check"), F.lit("F").alias("expected"), F.col("o_orderstatus").alias("actual"))
    scores = o.where("case_id % 4 = 0").select("case_id", F.when(F.col("case_id") % 8 == 0, "pass").otherwise("weak").alias("score"))
    return op.golden(o.drop("actual"), o.select("case_id", "check", "actual"), scores).select("case_id", "status")


@query("l13_gap_adjacent", "SELECT DISTINCT o_orderkey FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)")
def l13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap that is a key problem, by id."""
    return b.table(spark, sf_dir, "orders").join(b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("l16_expert_score", "SELECT p_partkey, round_even(15 + 15 * ((p_partkey % 5)::DOUBLE / 4) + 10 * ((p_size % 3)::DOUBLE / 2) + 5 * 0.5, 1) AS score FROM part")
def l16(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = {"选题价值": F.lit(1.0), "目标与指标合理性": (F.col("p_partkey") % 5).cast("double") / 4, "创新性": (F.col("p_size") % 3).cast("double") / 2, "成果与应用前景": F.lit(0.5), "资源合理性": F.lit(None).cast("double")}
    return b.table(spark, sf_dir, "part").select("p_partkey", op.expert_score(points).alias("score"))


@query("a2_levels_by_claim", f"WITH {EVIDENCE_SQL} SELECT claim_key, " + ", ".join(f"count(*) FILTER (support_level = '{x}') AS {x}" for x in ("direct", "strong_inference", "weak_inference", "context_only", "contradictory", "unsupported")) + " FROM evidence GROUP BY claim_key")
def a2_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.levels_by_claim(b.evidence(spark, sf_dir))


@query("f21_source_ids", "SELECT 'C-' || l_orderkey AS claim_id, count(DISTINCT l_partkey) FILTER (l_partkey % 17 <> 0) AS sources FROM lineitem GROUP BY l_orderkey")
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that aren't source ids count for nothing."""
    claims, sources, evidence = _graph(spark, sf_dir)
    d = claims_op.claim_statistics(claims, claims_op.edges_with_sources(evidence, sources))
    return d.where(F.col("n_support") + F.col("n_against") > 0).select("claim_id", F.col("independent").alias("sources"))


@query("f26_pdf_magic", "SELECT page_id, page_id % 2 = 0 AS is_pdf FROM pages")
def f26(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.operators.ingest import is_pdf

    content = F.concat(F.when(F.col("page_id") % 2 == 0, F.lit("%PDF-1.7 ")).otherwise("<html>"), F.substring("html", 1, 50)).cast("binary")
    return b.table(spark, sf_dir, "pages").select("page_id", is_pdf(content).alias("is_pdf"))


@query("sk3_audit_log", "SELECT l_orderkey::VARCHAR AS input_file, count(*) AS entries FROM lineitem GROUP BY l_orderkey")
def sk3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.sources.sinks import audit_log

    l = b.table(spark, sf_dir, "lineitem")
    rows = l.select(F.col("l_partkey").cast("string").alias("id"), F.lit("u").alias("url"), F.lit("failed").alias("status"), F.lit("r").alias("reason"), F.col("l_orderkey").cast("string").alias("input_file"))
    return audit_log(rows, "2026-01-01T00:00:00Z", "p").select("input_file", F.json_array_length(F.get_json_object("value", "$.entries")).cast("long").alias("entries"))
