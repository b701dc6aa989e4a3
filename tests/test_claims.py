"""The quick-start case and its variations: sufficiency, score, audit, brief marks."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import claims as op
from attesta.operators import manifests
from attesta.sources import readers

SOURCES = [
    {"source_id": "S1", "title": "One", "url": "https://a.org/1", "authority": "C1", "freshness": "recent"},
    {"source_id": "S2", "title": "Two", "url": "https://a.org/2", "authority": "A2", "freshness": "current"},
    {"source_id": "S3", "title": "Three", "url": "https://a.org/3", "authority": "B1", "freshness": "current"},
]
CLAIMS = [
    {"claim_to_write": "m", "claim_class": "M", "risk": "R2", "evidence_status": "supported", "source_support_levels": {"S1": "direct", "S3": "strong_inference"},
     "source_locators": {"S1": {"page": 3}, "S3": {"section": "2.1"}}, "counter_evidence_search": [{"q": "x"}]},
    {"claim_to_write": "n", "claim_class": "N", "risk": "R3", "evidence_status": "supported", "source_support_levels": {"S2": "direct", "S3": "direct"},
     "source_locators": {"S2": {"page": 1}, "S3": {"page": 2}}, "counter_evidence_search": "本次检索未找到公开反证"},
]


@pytest.fixture
def graph(spark, tmp_path):
    def make(claims=CLAIMS, sources=SOURCES):
        (tmp_path / "s.json").write_text(json.dumps({"sources": sources}, ensure_ascii=False))
        (tmp_path / "m.json").write_text(json.dumps({"evidence_map": claims}, ensure_ascii=False))
        c, e = readers.claims_and_edges(readers.evidence_map(spark, str(tmp_path / "m.json")))
        return c, readers.corpus_sources(readers.corpus(spark, str(tmp_path / "s.json"))), e

    return make


def rows(df):
    return {r["claim_id"]: r for r in df.collect()}


def test_quickstart(graph):
    got = rows(op.sufficiency(*graph()))
    assert [(got[c]["passed"], got[c]["score"], got[c]["grade"]) for c in ("C-001", "C-002")] == [(True, 86.5, "Good"), (True, 95.0, "Strong")]


def test_conservative_fails_both_and_exploratory_none(graph):
    assert not any(r["passed"] for r in op.sufficiency(*graph(), mode="conservative").collect())
    assert all(r["passed"] for r in op.sufficiency(*graph(), mode="exploratory").collect())


def test_one_weak_source(graph):
    claim = {"claim_class": "M", "risk": "R2", "source_support_levels": {"S1": "weak_inference"}, "counter_evidence": {"unknown": ["x"]}}
    assert rows(op.sufficiency(*graph([claim])))["C-001"]["reasons"] == "primary,independent"


def test_superseded_normative_source(graph):
    sources = [dict(SOURCES[0], authority="A3", freshness="superseded"), dict(SOURCES[1], authority="B1", freshness="recent")]
    claim = {"claim_class": "N", "risk": "R3", "source_support_levels": {"S1": "direct", "S2": "direct"}, "counter_search": {"q": 1}}
    assert rows(op.sufficiency(*graph([claim], sources)))["C-001"]["reasons"] == "current"


def test_claim_without_edges_and_missing_source(graph):
    got = rows(op.sufficiency(*graph([{"claim_class": "D", "risk": "R0"}, {"claim_class": "E", "risk": "R9", "source_support_levels": {"S9": "direct"}}])))
    assert (got["C-001"]["passed"], got["C-001"]["score"], got["C-001"]["grade"]) == (True, 0.0, "Insufficient")
    assert (got["C-002"]["passed"], got["C-002"]["primary_sources"], got["C-002"]["independent"]) == (True, 0, 1)


def test_changed_only(spark, graph):
    claims, sources, evidence = graph()
    changed = spark.createDataFrame([("C-001",), ("x",)], "claim_id string")
    assert [r["claim_id"] for r in op.sufficiency(op.changed_only(claims, changed), sources, evidence).collect()] == ["C-001"]


def test_audit(graph):
    claims, _, evidence = graph()
    assert op.audit_summary(op.auditability(claims, evidence)).first().asDict() | {} == {"claims": 2, "edges": 4, "lost": 0, "high_risk": 1, "high_risk_failing": 0, "ratio": 1.0, "passed": True}
    claims, _, evidence = graph([{"claim_class": "E", "risk": "R3", "source_support_levels": {"S1": "direct"}, "source_locators": {"S1": {"locator_quality": "high"}}}])
    got = op.audit_summary(op.auditability(claims, evidence)).first()
    assert (got["high_risk_failing"], got["passed"]) == (1, False)


def test_explicit_relation_wins_and_balance(graph):
    claim = {"claim_class": "E", "risk": "R1", "source_support_levels": {"S1": "direct", "S2": "contradictory", "S3": "context_only"}, "source_relations": {"S1": "contradicts"}}
    claims, sources, evidence = graph([claim])
    assert {r["source_key"]: r["relation"] for r in evidence.collect()} == {"S1": "contradicts", "S2": "contradicts", "S3": "context_only"}
    assert op.balance(claims, sources, evidence).first()["mark"] == "−"


def test_manifest_round_trip(spark, graph):
    claims, sources, evidence = graph()
    m = manifests.claim_manifests(claims, op.edges_with_sources(evidence, sources), "2026-08-02")
    body = json.loads(m.first()["manifest"])
    assert [c["claim_id"] for c in body["claims"]] == ["C-001", "C-002"]
    assert "confidence" not in body["claims"][0]
    assert manifests.contract_problems(m.select(F.lit("d").alias("doc_id"), F.col("manifest").alias("json"))).count() == 0
    assert [[(e["source_id"], e["locator"]) for e in c["evidence"]] for c in body["claims"]] == [[("S1", {"page": 3}), ("S3", {"section": "2.1"})], [("S2", {"page": 1}), ("S3", {"page": 2})]]


def test_manifest_states_what_was_recorded(spark, graph):
    claim = {"claim_to_write": "long " * 60, "claim_class": "M", "risk": "R2", "confidence": "high", "interpretation": " as written ", "reconciliation": {"verdict": "supported"}, "source_support_levels": {"S1": "direct"}, "source_locators": {"S1": {"section": "4", "quote_hash": "ab"}}}
    claims, sources, evidence = graph([claim])
    got = json.loads(manifests.claim_manifests(claims, op.edges_with_sources(evidence, sources), "2026-08-02").first()["manifest"])["claims"][0]
    assert got["claim_text"] == ("long " * 60).strip() and (got["verdict"], got["confidence"], got["interpretation"]) == ("supported", "high", "as written")
    assert got["evidence"][0]["locator"] == {"section": "4", "quote_hash": "ab"} and "evidence_status" not in got


def test_only_source_ids_are_independent(graph):
    got = rows(op.sufficiency(*graph([{"claim_class": "E", "risk": "R1", "source_support_levels": {"G1": "direct"}}])))
    assert (got["C-001"]["passed"], got["C-001"]["independent"], got["C-001"]["reasons"]) == (False, 0, "independent")


def test_any_field_of_a_locator_makes_a_source_traceable(graph):
    claim = {"claim_class": "E", "risk": "R1", "source_support_levels": {"S9": "direct"}}
    plain = rows(op.sufficiency(*graph([claim])))["C-001"]["score"]
    assert rows(op.sufficiency(*graph([claim | {"source_locators": {"S9": {"quote_hash": "ab"}}}])))["C-001"]["score"] == plain + 15
