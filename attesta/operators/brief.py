"""Reports over the graph: the evidence brief, stage gates, download runs, review rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import contracts as k
from attesta.functions.evidence import balance_of, blank, id_of, place_of
from attesta.operators import claims as op


def source_label(source_id: Column, authority: Column, freshness: Column, relation: Column, level: Column, place: dict[str, Column]) -> Column:
    """A source as the brief shows it, with every field of its place that isn't empty, by name."""
    shown = lambda c: F.when(blank(c), F.lit("?")).otherwise(c)
    parts = F.concat_ws("/", F.when(source_id.startswith("S"), source_id).otherwise(F.concat(F.lit("S"), source_id)), shown(authority), shown(freshness), F.when(relation != "", relation), F.when(level != "", level))
    fields = [F.when(~x.cast("string").isin("", "0"), F.concat(F.lit(f"{name}="), x.cast("string"))) for name, x in sorted(place.items())]
    where = F.concat_ws(" ", *fields)
    return F.concat(parts, F.when(where != "", F.concat(F.lit(" @"), where)).otherwise(""))


def brief_relation(level: Column, explicit: Column | None = None) -> Column:
    """As elsewhere, but an unsupported level keeps its name; it counts as support all the same."""
    derived = F.when(level == "contradictory", "contradicts").when(level == "context_only", "context_only").when(level == "unsupported", "unsupported").otherwise("supports")
    return derived if explicit is None else F.coalesce(F.when(explicit != "", explicit), derived)


# Characters of a claim in the brief's table, its columns, and what it says of itself.
SHOWN_CHARS = 60
COLUMNS = ("Claim", "class", "risk", "论断", "支持", "反证", "status", "平衡", "置信度", "评分")
WEIGHTS = "权威 25 / 直接度 20 / 独立 15 / 新鲜 10 / 可溯 15 / 反证 10 / 可复现 5——评分不替代硬门禁"
HEAD = """# Evidence Brief

- 生成时间：{on}
- 审查模式：{mode}（evidence 乘数 {multiplier:g}）｜profile：{profile}
- 声明：本表只呈现证据、充分性判定与评分，**结论由 agent/用户填写**，脚本不代写。
- 评分：Evidence Score 0–100（权威25/直接度20/独立15/新鲜10/可溯15/反证10/可复现5）；**
  评分不替代硬门禁**，先过门禁再看分。

## 汇总

| {columns} |
| {rules} |
"""
FOOT = "\n\n## 结论（由 Agent 填写）\n\n> 基于上表证据态势，给出结论；证据不足处如实降级/留白，不得越过充分性判定下强结论。\n"


def brief_rows(claims: DataFrame, sources: DataFrame, evidence: DataFrame, mode: str = "balanced") -> DataFrame:
    """SK9: one row of the brief's table for each claim, and the lines of its details.

    Claims may have claim_text, evidence_status, verdict and confidence; without a verdict the status counts, without a confidence medium.
    """
    said = {x: F.trim(F.coalesce(F.col(x) if x in claims.columns else F.lit(""), F.lit(""))) for x in ("claim_text", "evidence_status", "verdict", "confidence")}
    judged = op.sufficiency(claims.withColumns(said), sources, evidence, mode)
    edges = op.edges_with_sources(evidence, sources).withColumn("shown", brief_relation(F.col("support_level"), F.when(F.col("relation") == "contradicts", F.col("relation"))))
    label = source_label(id_of(edges), F.col("authority"), F.col("freshness"), F.col("shown"), F.col("support_level"), place_of(edges))
    listed = lambda when: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("source_key", label.alias("t"))))), lambda x: x["t"]), "；")
    against, context = F.col("shown") == "contradicts", F.col("shown") == "context_only"
    lists = edges.groupBy("claim_key").agg(listed(~against & ~context).alias("support"), listed(against).alias("against"), listed(context).alias("context"))
    d = judged.join(lists, "claim_key", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("support", "against", "context")})
    n_support = F.col("n_support") - F.col("n_context")
    or_ = lambda x, other: F.coalesce(F.nullif(F.col(x), F.lit("")), other)
    d = d.withColumns({"mark": balance_of(n_support, F.col("n_against"), F.col("n_context")), "shown_status": or_("evidence_status", F.lit("-")), "verdict": or_("verdict", F.col("evidence_status")), "confidence": or_("confidence", F.lit("medium")), "shown_score": F.concat(F.format_string("%.1f", "score"), F.lit("/"), "grade")})
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "claim_id", "claim_class", "risk", F.substring("claim_text", 1, SHOWN_CHARS), n_support.cast("string"), F.col("n_against").cast("string"), "shown_status", "mark", "confidence", "shown_score"), F.lit(" |"))
    return d.withColumn("line", line)


def brief(rows: DataFrame, on: str, mode: str = "balanced", profile: str = "default") -> DataFrame:
    """(case_key, brief): a Markdown table in order of claims, how many are sufficient, and for each its sources, status, score and what it lacks."""
    multiplier = k.REVIEW_MODES[mode][0]
    told = f"{mode}，乘数 {multiplier:g}"
    lacks = F.array_join(F.transform(F.split("reasons", ","), lambda x: F.concat(F.lit("    - "), F.trim(x))), "\n\n")
    detail = F.concat(F.lit("### "), "claim_id", F.lit(" ["), "risk", F.lit("/"), "claim_class", F.lit("] "), "claim_text", F.lit("\n\n"), F.array_join(F.array_compact(F.array(
        F.when(F.col("support") != "", F.concat(F.lit("- 支持："), "support")), F.when(F.col("against") != "", F.concat(F.lit("- 反证："), "against")), F.when(F.col("context") != "", F.concat(F.lit("- 背景："), "context")),
        F.concat(F.lit("- 状态/判决："), "shown_status", F.lit(" / "), "verdict", F.lit(" | 平衡："), "mark", F.lit(" | 置信度："), "confidence"),
        F.concat(F.lit("- Evidence Score：**"), F.format_string("%.1f", "score"), F.lit("（"), "grade", F.lit(f"）**（{WEIGHTS}）")),
        F.when(F.col("passed"), F.lit(f"- 充分性：✅ 达标（{told}）")).otherwise(F.concat(F.lit(f"- 充分性：❌ 不足（{told}）：\n\n"), lacks)),
    )), "\n\n"))
    d = rows.groupBy("case_key").agg(F.sort_array(F.collect_list(F.struct("claim_key", "line", detail.alias("detail")))).alias("r"), F.count_if("passed").alias("ok"), F.count("*").alias("n"))
    joined = lambda f, sep: F.array_join(F.transform("r", lambda x: x[f]), sep)
    head = HEAD.format(on=on, mode=mode, multiplier=multiplier, profile=profile, columns=" | ".join(COLUMNS), rules=" | ".join("---" for _ in COLUMNS))
    return d.select("case_key", F.concat(F.lit(head), joined("line", "\n"), F.lit("\n\n证据充分性：**"), F.col("ok").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("** claim 达标。\n\n## 逐条详情\n\n"), joined("detail", "\n\n"), F.lit(FOOT)).alias("brief"))


# The gates of a workspace: name, pattern of a file's path, whether it must be there.
GATES = (
    ("0", r"^00_topic\.md$", True), ("1", r"^02_raw_sources\.json$", True), ("2", r"^03_audit_report\.md$", True), ("3", r"^04_validated_sources\.json$", True), ("3a", r"^reference_files/[^/]+\.pdf$", True), ("3c", r"^pdf_text/[^/]+\.txt$", True),
    ("4", r"^06_evidence_map\.json$", True), ("4b", r"^07_honest_assessment\.md$", True), ("5", r"^08_初稿\.md$", True), ("6", r"^10_review\.md$", True), ("7", r"^11_定稿\.md$", True),
    ("8", r"^12_外部专家意见\.md$", False), ("9", r"^14_专家修订稿\.md$", False), ("10", r"^[^/]+\.pdf$", False),
)


ACCESS_GATE = "3b"


def stage_gates(files: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(case_key, missing, passed) from files (case_key, path, bytes); an empty text file doesn't count.

    With the cases' corpus (case_key, access_status), F27 is a gate too: every source has an access status. A case without sources fails it.
    """
    there = files.where((F.col("bytes") > 0) | ~F.col("path").rlike(r"\.txt$"))
    d = there.groupBy("case_key").agg(*[F.coalesce(F.bool_or(F.col("path").rlike(p)), F.lit(False)).alias(f"g{n}") for n, p, _ in GATES])
    names = [n for n, _, hard in GATES if hard]
    if corpus is not None:
        told = corpus.groupBy("case_key").agg(F.every(~blank(F.col("access_status"))).alias(f"g{ACCESS_GATE}"))
        d = d.join(told, "case_key", "left").withColumn(f"g{ACCESS_GATE}", F.coalesce(f"g{ACCESS_GATE}", F.lit(False)))
        names.insert(names.index("3a") + 1, ACCESS_GATE)
    missing = F.array_compact(F.array(*[F.when(~F.col(f"g{n}"), F.lit(n)) for n in names]))
    return d.select("case_key", F.array_join(missing, ",").alias("missing")).withColumn("passed", F.col("missing") == "")


# What may be done about a comment of a review, and the severity that must be cleared.
DISPOSITIONS = ("已修改", "已降级表达", "已移入补充调研清单", "资料不足暂不写入正文", "保留原表述并说明理由")
BLOCKER, KEPT = "阻断", "保留原表述并说明理由"


def response_problems(comments: DataFrame, responses: DataFrame) -> DataFrame:
    """(review, comment, problem) of comments (review, comment, severity) by the responses (review, comment, disposition): none, one of
    another disposition than those known, or a blocker whose passage was kept. Of several responses the worst counts."""
    d = comments.join(responses, ["review", "comment"], "left")
    kind = F.col("disposition")
    problem = F.when(kind.isNull(), "no response").when(~kind.isin(*DISPOSITIONS), "unknown disposition").when((F.col("severity") == BLOCKER) & (kind == KEPT), "blocker not cleared")
    return d.groupBy("review", "comment").agg(F.max(problem).alias("problem")).where(F.col("problem").isNotNull())


def golden(cases: DataFrame, results: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Each check of a golden case (case_id, manual, check, expected) with its status by the results (case_id, check, actual).

    Manual cases aren't judged, but by the scores (case_id, score) that people gave: any but `pass` fails (J14), one of
    several too; scores of other cases count for nothing. A check without a result is an error.
    """
    d = cases.join(results.withColumn("_there", F.lit(True)), ["case_id", "check"], "left")
    same = F.col("expected").eqNullSafe(F.col("actual"))
    d = d.withColumn("status", F.when(F.col("manual"), "manual").when(F.col("_there").isNull(), "error").when(same, "passed").otherwise("failed")).drop("_there")
    if scores is None:
        return d
    given = scores.groupBy("case_id").agg(F.every(F.coalesce(F.col("score") == "pass", F.lit(False))).alias("_given"))
    scored = F.when((F.col("status") != "manual") | F.col("_given").isNull(), F.col("status")).when(F.col("_given"), "passed").otherwise("failed")
    return d.join(given, "case_id", "left").withColumn("status", scored).drop("_given")


def golden_summary(judged: DataFrame, least_passed: int = 15, least_manual: int = 4) -> DataFrame:
    """G16, SK10: cases by status, the worst of their checks counting, whether the gate passes, and the report's lines."""
    order = F.create_map(*[F.lit(x) for pair in (("error", 3), ("failed", 2), ("passed", 1), ("manual", 0)) for x in pair])
    by = judged.groupBy("case_id").agg(F.max_by("status", order[F.col("status")]).alias("status"))
    n = {x: F.count_if(F.col("status") == x).alias(x) for x in ("passed", "failed", "error", "manual")}
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("case_id", "status"))), lambda x: F.concat(F.lit("| "), x["case_id"], F.lit(" | "), x["status"], F.lit(" |"))), "\n")
    d = by.agg(*n.values(), lines.alias("lines"))
    return d.withColumn("gate", (F.col("failed") == 0) & (F.col("error") == 0) & (F.col("passed") >= least_passed) & (F.col("manual") >= least_manual))


def download_summary(rows: DataFrame) -> DataFrame:
    """Counts by status of each run, and whether it passes: nothing failed, nothing was blocked."""
    d = rows.groupBy("run").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("downloaded", "exists", "not_pdf", "failed")], F.count_if(F.col("status").startswith("blocked")).alias("blocked"))
    return d.withColumn("passed", (F.col("failed") == 0) & (F.col("blocked") == 0))


def gap_items(raw: Column) -> Column:
    """Entries of the first of three lists that a gap file has."""
    size = lambda key: F.json_array_length(F.get_json_object(raw, f"$.{key}"))
    return F.coalesce(size("global_gaps"), size("unsupported_but_needed_claims"), size("evidence_gaps"), F.lit(0))


def prompt_rules(rules: Column, forbidden: Column) -> Column:
    """P20: rules in order of their keys, then what is forbidden."""
    pairs = F.filter(F.array_sort(F.map_entries(rules)), lambda e: F.trim(e["value"]) != "")
    return F.concat(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), F.trim(e["value"]))), F.transform(forbidden, lambda f: F.concat(F.lit("forbid/"), f["id"], F.lit(": "), f["description"])))


# Dimensions of an expert's review and their points; they make 100.
EXPERT_WEIGHTS = {"选题价值": 15, "研究现状与问题分析": 10, "目标与指标合理性": 15, "技术/方法路线可行性": 15, "创新性": 10, "证据链与引用质量": 10, "实施与风险控制": 10, "资源合理性": 10, "成果与应用前景": 5}


def expert_score(points: dict[str, Column], weights: dict[str, int] | None = None) -> Column:
    """A weighted sum of dimensions, each from 0 to 1; a dimension without points counts for nothing."""
    weights = weights or EXPERT_WEIGHTS
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(points.get(name, F.lit(0.0)), F.lit(0.0)) * w
    return F.bround(total, 1)


def levels_by_claim(evidence: DataFrame) -> DataFrame:
    """How many edges of each support level a claim has, in a column for each level."""
    return evidence.groupBy("claim_key").pivot("support_level", list(k.SUPPORT_LEVELS)).count().na.fill(0)

