"""The final gate over small documents."""

from pyspark.sql import functions as F

from attesta.operators import final_gate as op

FINAL = "# t\n\n正文[1]和[2]。\n\n## 参考文献\n[1] a. https://x.org/1\n[2] b. https://x.org/2\n"
DRAFT = "# t\n\n正文[S1]和[S2]。\n\n## 参考文献\n[S1] a. https://x.org/1\n[S2] b. https://x.org/2\n"


def texts(spark, **docs):
    return spark.createDataFrame(list(docs.items()), "doc_id string, {} string".format("final"))


def failing(spark, docs, verdicts, **options):
    return {r["doc_id"]: r for r in op.released(docs, verdicts, **options).collect()}


def test_gates_of_finished_texts(spark):
    finals = texts(
        spark, good=FINAL, mark=FINAL.replace("和", "[S3]和"), cover=FINAL + "编号：2023xxxx\n", open=FINAL.replace("和[2]", "和[3]"), jump=FINAL.replace("[2]", "[4]"), twice=FINAL + "\n## 3. 参考文献\n[1] a\n", same=FINAL.replace("x.org/2", "x.org/1"), none=None,
    )
    docs = finals.select("doc_id", F.array().cast("array<string>").alias("kinds"))
    drafts = finals.select("doc_id", F.lit(DRAFT).alias("text"))
    got = failing(spark, docs, op.final_verdicts(finals).unionByName(op.draft_verdicts(drafts)))
    assert got["good"]["released"] and got["good"]["failing"] == []
    gates = {x: "".join(g for g in "abcd" if not r[g]) for x, r in got.items()}
    assert (gates["mark"], gates["cover"], gates["open"], gates["jump"], gates["same"], gates["none"]) == ("a", "a", "b", "b", "d", "abd")
    assert "D one reference section: 2" in got["twice"]["failing"] and got["jump"]["failing"] == ["B sequence: 2,3"]


def test_absent_checks_fail(spark):
    docs = spark.createDataFrame([("a", ["case"]), ("b", ["framework", "unheard"]), ("c", None)], "doc_id string, kinds array<string>")
    rows = spark.createDataFrame([("a", "s1", True), ("a", "s2", False), ("b", "s1", True), ("other", "s1", False)], "doc_id string, s string, ok boolean")
    v = op.case_verdicts("corpus", rows, F.col("ok"), F.col("s")).unionByName(op.case_verdicts("stages", rows.where("s = 's1'"), F.col("ok")))
    got = failing(spark, docs, v, basic=())
    assert got["a"]["failing"] == ["C audit: absent", "C corpus: s2"] and got["b"]["failing"] == ["C framework depth: absent"]
    assert got.keys() == {"a", "b"} and not got["a"]["c"] and got["a"]["a"]
    again = failing(spark, docs, v.unionByName(v.withColumn("passed", F.lit(False)).where("check = 'stages'")), basic=())
    assert "C stages" in again["a"]["failing"]


def test_drafts_and_frameworks(spark):
    d = spark.createDataFrame([("good", DRAFT), ("open", DRAFT.replace("和[S2]", "")), ("null", None)], "doc_id string, text string")
    got = {(r["doc_id"], r["check"]): (r["passed"], r["reason"]) for r in op.draft_verdicts(d, min_sources=2, min_chars=3).collect()}
    assert got["good", "closure"] == (True, "") and got["good", "minimum"][0] and got["open", "closure"] == (False, "unused=2") and not got["null", "closure"][0]
    deep = "## 1. 方案\n目标 方法 输入 标准 " + "字" * 30 + "\n"
    f = spark.createDataFrame([("deep", deep), ("thin", deep + "## 2. 短\n目标\n"), ("none", "x")], "doc_id string, text string")
    got = {r["doc_id"]: (r["passed"], r["reason"]) for r in op.framework_verdicts(f, 20).collect()}
    assert got == {"deep": (True, ""), "thin": (False, "短"), "none": (False, "no chapters")}


def test_residuals_are_counted_once_a_text(spark):
    """Each pattern is in the plan once, and tried on texts that hold its fixed part."""
    finals = texts(spark, good=FINAL, left=FINAL + "[S3] 待填写 ?3] [Gx]\n", map=FINAL + "### [Sx]↔[n] 对照表\n[S3] 待填写\n", none=None)
    assert {r["doc_id"]: [(x["name"], x["n"]) for x in r["x"]] for r in finals.select("doc_id", op.citations.residuals(F.col("final")).alias("x")).collect()} == {"good": [], "left": [("[Sx]", 1), ("待填写", 1), ("[?n]", 1)], "map": [], "none": []}
    verdicts = op.final_verdicts(finals)
    assert verdicts._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lambda") == 14
    assert {(r["doc_id"], r["reason"]) for r in verdicts.where("check = 'residuals' and not passed").collect()} == {("left", "[Sx],待填写,[?n]")}


def test_rows_of_verdicts_release_as_the_long_table_does(spark):
    """A draft's and its finished text's verdicts come from one pass, and gates, reasons and absent checks are those of the long table."""
    drafts = spark.createDataFrame(
        [("good", DRAFT), ("open", DRAFT.replace("和[S2]", "")), ("cover", DRAFT.replace("正文", "资助 references/x.md <!-- a -->\n\n\n\n编号：2023123 正文")), ("gap", DRAFT.replace("和", "[G1]和[S9]") + "\n## 附录A 缺口\n| [G1] | gap |\n"), ("null", None), ("bare", "x")],
        "doc_id string, text string",
    )
    docs = drafts.select("doc_id", F.when(F.col("doc_id").isin("good", "gap", "bare"), F.array(F.lit("case"))).alias("kinds"))
    case = op.case_verdicts("audit", spark.createDataFrame([("good", "s", True), ("gap", "t", False), ("gap", "u", False), ("open", "v", False), ("stranger", "s", False)], "doc_id string, s string, ok boolean"), F.col("ok"), F.col("s"))
    long = op.final_verdicts(op.citations.finished(drafts).select("doc_id", "final"), 2).unionByName(op.draft_verdicts(drafts, 2, 3)).unionByName(case)
    kinds = {"case": (("C", "audit"),)}
    rows = op.released_rows(docs, [op.delivery_rows(drafts, 2, 3), op.case_rows(case)], by_kind=kinds)
    got, want = ({r["doc_id"]: r.asDict() for r in d.collect()} for d in (rows, op.released(docs, long, by_kind=kinds)))
    assert got == want and got["good"]["released"] and "C audit: t;u" in got["gap"]["failing"] and "C audit: absent" in got["bare"]["failing"] and len(got) == 6
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan
