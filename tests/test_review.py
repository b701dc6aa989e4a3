"""Rules of search and review against small cases."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import review

CLAIMS = "case_key string, claim_key string, target string, core boolean, searched boolean"
EDGES = "case_key string, source_key string, claim_key string, relation string"
ARRIVALS = "case_key string, place int, source_key string, country string, institution string, kind string, publisher string"


def search(case, n, searched=True, country=lambda i: f"c{i % 2}", kind=lambda i: "page"):
    """Six targets, P1 core; source i speaks of target i, the seventh of P1 again; the rest repeat P1."""
    claims = [(case, f"{case}-{t}", t, t == "P1", searched) for t in review.TARGETS]
    arrivals = [(case, i, f"s{i}", country(i), "same", kind(i), f"j{i % 3}") for i in range(1, n + 1)]
    edges = [(case, f"s{i}", f"{case}-{review.TARGETS[i - 1] if i <= 6 else 'P1'}", "supports") for i in range(1, n + 1)]
    return claims, arrivals, edges


def stops(spark, *cases, extra=(), **options):
    claims, arrivals, edges = ([x for c in cases for x in c[i]] for i in range(3))
    d = review.stop_rule(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(arrivals, ARRIVALS), spark.createDataFrame([*edges, *extra], EDGES), **options)
    return {r["case_key"]: r.asDict() for r in d.collect()}


def test_stop_rule(spark):
    got = stops(
        spark, search("a", 20), search("few", 9), search("unsearched", 20, searched=False), search("alike", 20, country=lambda i: "x"), search("late", 20, country=lambda i: "x" if i < 15 else "y"),
        search("news", 20), search("onepaper", 20, kind=lambda i: "paper" if i == 9 else "page"), search("papers", 20, kind=lambda i: "paper" if i in (9, 14) else "page"),
        extra=[("news", "s11", "news-P2", "contradicts"), ("news", "s12", "news-P2", "contradicts"), ("news", "gone", "news-P3", "contradicts")], least_sources=8,
    )
    # Six sources bring a claim each, the seventh the second source of P1: ready there; idle from the seventh on.
    assert got["a"] == {"case_key": "a", "sources": 20, "ready_at": 7, "saturated_at": 11, "stop_at": 11, "short": True}
    assert (got["few"]["ready_at"], got["few"]["stop_at"]) == (7, None)
    assert got["unsearched"]["saturated_at"] == 11 and got["unsearched"]["stop_at"] is None and not got["unsearched"]["short"]
    assert got["alike"]["stop_at"] is None
    assert (got["late"]["ready_at"], got["late"]["stop_at"], got["late"]["short"]) == (15, 15, False)
    # A first contradiction of P2 with s11 breaks the run; the second is none; an edge of a source that never came counts for nothing.
    assert (got["news"]["saturated_at"], got["news"]["stop_at"]) == (16, 16)
    assert got["onepaper"]["stop_at"] is None and (got["papers"]["ready_at"], got["papers"]["stop_at"]) == (7, 14)


def test_stop_rule_shuffles_arrivals_once_stored(spark, tmp_path):
    """What is read of arrivals after they are stored: no join of edges to places, and the same places whether edges are a column or a table."""
    claims, arrivals, edges = (spark.createDataFrame(x, s) for x, s in zip(search("a", 20), (CLAIMS, ARRIVALS, EDGES), strict=True))
    of = edges.groupBy("case_key", "source_key").agg(F.collect_set(F.struct("claim_key", "relation")).alias("edges"))
    column = review.stop_rule(claims, arrivals.join(of, ["case_key", "source_key"]), None, least_sources=8)
    assert column.collect() == review.stop_rule(claims, arrivals, edges, least_sources=8).collect()
    plan = column._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 5 and "institution" not in plan


def test_runs_are_of_sources_not_claims(spark):
    _, arrivals, edges = search("a", 13)
    d = review.news(spark.createDataFrame(arrivals, ARRIVALS), spark.createDataFrame([*edges, ("a", "s13", "new", "context_only")], EDGES))
    got = {r["place"]: (r["new_claims"], r["idle"], r["run"]) for r in d.collect()}
    assert got[6] == (1, False, 0) and got[12] == (0, True, 6) and got[13] == (1, False, 0)


def draft(case, intro, survey, rest, refs=True):
    marks = lambda xs: " ".join(f"[S{x}]" for x in xs)
    return case, f"# t\n## 1. 绪论\n{marks(intro)}\n## 第二章 文献综述\n{marks(survey)} [S9](u)\n## 3. 方案\n{marks(rest)}\n" + (f"## 参考文献\n{marks(range(50, 99))}\n" if refs else "")


def test_review_gate(spark):
    docs = spark.createDataFrame([draft("a", [1, 2], [2, 3], [4, 5]), draft("b", [1, 2, 6], [2, 3], [4, 5]), draft("none", [], [], []), draft("c", [1], [1, 1], [1], False), ("plain", "[S1]")], "doc_id string, text string")
    shares = {r["doc_id"]: (r["body_sources"], r["review_sources"], r["share"], r["enough"]) for r in review.review_share(docs).collect()}
    assert shares == {"a": (5, 2, 0.4, True), "b": (6, 2, 0.333, False), "none": (0, 0, None, False), "c": (1, 1, 1.0, True), "plain": (1, 0, 0.0, False)}
    a, c = search("a", 7), search("c", 3)
    got = {r["doc_id"]: r for r in review.review_gate(docs, spark.createDataFrame(a[0] + c[0], CLAIMS), spark.createDataFrame(a[2] + c[2] + [("c", "s1", "c-P1", "supports"), ("c", "x", "c-T3", "contradicts")], EDGES)).collect()}
    assert got["a"]["passed"] and not got["a"]["uncovered"]
    assert got["c"]["enough"] and got["c"]["uncovered"] == ["T1", "T2", "T3"] and got["c"]["weak_core"] == ["c-P1"] and not got["c"]["passed"]
    assert got["plain"]["uncovered"] == list(review.TARGETS)


@pytest.mark.parametrize(
    ("gaps", "verdict"),
    [
        ([("acceptable", None, None)], "enter"), ([("high", None, False)], "enter"), ([("high", None, True), ("high", None, True)], "conditional"), ([("high", None, True), ("high", None, None)], "search"),
        ([("blocking", True, None)], "search"), ([("blocking", False, None)], "search"), ([("blocking", False, None), ("blocking", True, None)], "search"), ([("blocking", False, None), ("blocking", None, None)], "stop"),
    ],
)
def test_entry_verdict(spark, gaps, verdict):
    d = spark.createDataFrame([("a", *g) for g in gaps], "case_key string, grade string, fillable boolean, bridgeable boolean")
    assert review.entry_verdict(d).first()["verdict"] == verdict


def test_use_of_sources(spark):
    rows = [("confirmed", "core", False, "core"), ("confirmed", "lead_only", True, "none"), ("web_accessible", "supporting", False, "support"), ("web_accessible", "background", True, "none"), ("unavailable", "core", True, "auxiliary"), ("unavailable", "core", None, "none"), (None, "core", True, "none"), ("confirmed", None, True, "none")]
    d = spark.createDataFrame(rows, "access string, role string, checkable boolean, want string")
    assert d.where(review.usable(F.col("access"), F.col("role"), F.col("checkable")) != F.col("want")).count() == 0
