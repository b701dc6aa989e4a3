import json

from pyspark.sql import functions as F

from attesta.operators import manifests as op
from attesta.sources import sinks

GOOD = {"schema_version": "0.2.0", "review_kind": "ai-internal", "verification_mode": "live", "finalized_at": "2026-08-02"}


def problems(spark, *docs):
    df = spark.createDataFrame([(str(i), d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "doc_id string, json string")
    out = {str(i): set() for i in range(len(docs))}
    for r in op.contract_problems(df).collect():
        out[r["doc_id"]].add((r["path"], r["problem"]))
    return list(out.values())


def claim(**x):
    return {"claim_id": "C-1", "claim_class": "E", "claim_text": "t", "evidence": []} | x


def test_contract(spark):
    edge = {"source_id": "S1", "support_level": "direct"}
    got = problems(
        spark, GOOD | {"claims": [claim(evidence=[edge | {"locator": {"section": "2", "locator_quality": "low", "quote_hash": None}}])]},
        GOOD | {"claims": [claim(claim_class="X", evidence=[edge | {"support_level": "bogus"}])]}, {k: v for k, v in GOOD.items() if k != "review_kind"},
        GOOD | {"claims": [claim(confidence="certain", evidence=[edge | {"relation": "rejects", "locator": {"page": "x", "locator_quality": "bogus"}}])]},
        GOOD | {"claims": [], "review_independence": {"human_involvement": "maybe", "context_shared": "yes"}}, "[1]", "no json", None and {} or GOOD | {"schema_version": "9.9.9", "claims": "x"},
        GOOD | {"schema_version": "0.1.0", "mapping": [{"citation": "[S1]", "mapped": "[1]", "source_id": "S1"}, {"citation": "S1", "mapped": "1", "source_id": "S1", "url": "ftp://x"}]},
    )
    assert got[0] == set()
    assert got[1] == {("claims[0]", "illegal claim_class"), ("claims[0].evidence[0]", "illegal support_level")}
    assert got[2] == {("", "missing review_kind"), ("", "neither mapping nor claims")}
    assert got[3] == {("claims[0]", "illegal confidence"), *(("claims[0].evidence[0]", x) for x in ("illegal relation", "locator.page must be an integer", "illegal locator_quality"))}
    assert got[4] == {("review_independence", "illegal human_involvement"), ("review_independence", "context_shared must be a boolean")}
    assert got[5] == got[6] == {("", "root must be an object")}
    assert got[7] == {("", "schema_version"), ("", "claims must be an array")}
    assert got[8] == {("mapping[1]", x) for x in ("citation format", "mapped format", "url scheme", "duplicate source_id")}


def test_migration_keeps_unknown_fields_and_is_idempotent(spark):
    old = GOOD | {"schema_version": "0.1.0", "own": 1, "claims": [claim(evidence=[{"source_id": "S1", "support_level": "contradictory"}, {"source_id": "S2", "support_level": "direct", "relation": "context_only"}])]}
    df = spark.createDataFrame([(json.dumps(old),), (json.dumps(GOOD | {"schema_version": "9"}),), ("x",), (None,)], "json string")
    got = [r[0] for r in df.select(op.migrated("json")).collect()]
    new = json.loads(got[0])
    assert (new["schema_version"], new["own"], [e["relation"] for e in new["claims"][0]["evidence"]]) == ("0.2.0", 1, ["contradicts", "context_only"])
    assert new["review_independence"]["context_shared"] is True
    assert got[1:] == [None, None, None]
    again = spark.createDataFrame([(got[0],)], "json string").select(op.migrated("json")).first()[0]
    assert again == got[0]


def test_migration_of_odd_trees(spark):
    """Unknown fields at every level, entries that are no objects, numbers, quotes and nulls stay."""
    claims = [None, 7, "x", [1], {}, {"evidence": None}, {"evidence": {"support_level": "direct"}}, {"own": {"deep": [1, {"é\"": None}]}, "evidence": [None, 3, ["e"], {}, {"support_level": 5}, {"support_level": "contradictory", "own": [True]}, {"relation": None, "support_level": "direct"}]}]
    rows = [{"schema_version": "0.1.0", "claims": c, "n": 12345678901234567890, "z": 1.5} for c in (claims, None, {"a": 1}, "x")] + [{"schema_version": "0.1.0"}, {"schema_version": "0.1.0", "review_independence": None}]

    def want(data):
        out = json.loads(json.dumps(data)) | {"schema_version": "0.2.0"}
        out.setdefault("review_independence", {"human_involvement": "none", "context_shared": True, "evidence_shared": True})
        for c in out["claims"] if isinstance(out.get("claims"), list) else []:
            for e in c["evidence"] if isinstance(c, dict) and isinstance(c.get("evidence"), list) else []:
                if isinstance(e, dict) and "relation" not in e:
                    e["relation"] = {"contradictory": "contradicts", "context_only": "context_only"}.get(e.get("support_level"), "supports")
        return out

    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(rows)], "i int, json string")
    got = [json.loads(r[0]) for r in df.orderBy("i").select(op.migrated("json")).collect()]
    assert got == [want(x) for x in rows]
    odd = spark.createDataFrame([(x,) for x in ("[]", "7", '{"schema_version": 0.1}', '{"schema_version": null}', "")], "json string").select(op.migrated("json"))
    assert [r[0] for r in odd.collect()] == [None] * 5
    assert "Python" not in df.select(op.migrated("json"))._jdf.queryExecution().toString()


def test_verdicts(spark):
    df = spark.createDataFrame([("10_review_a.md", "x\n**判决**： 小修 \ny"), ("own.md", "none")], "file string, text string")
    assert [(r["stage"], r["verdict"]) for r in op.verdicts(df).collect()] == [("r4 初稿审查", "小修")]


def test_bundles_by_case(spark, tmp_path):
    """One bad case of three leaves two bundles; a run counts once it is committed, and a later one replaces a case's bundle."""
    claims = spark.createDataFrame([(1, "C-001", "a", "E", "R2"), (2, "C-001", "b", "E", "R2"), (3, "C-001", "c", "BAD", "R2")], "claim_key long, claim_id string, case_key string, claim_class string, risk string")
    edges = spark.createDataFrame([(c, f"S{c}", f"S{c}", "direct", "supports", "A1", "current") for c in (1, 2, 3)], "claim_key long, source_key string, source_id string, support_level string, relation string, authority string, freshness string")
    mapping = {"schema_version": "0.2.0", "review_kind": "ai-internal", "verification_mode": "static", "finalized_at": "2026-01-01", "mapping": [{"citation": "[S1]", "mapped": "[1]", "source_id": "S1", "own": 1}]}
    maps = [(x, json.dumps(mapping)) for x in "abcd"] + [("f", json.dumps(mapping | {"mapping": [{"citation": "S1"}]}))]
    reviews = spark.createDataFrame([("a", "10_review.md", "**判决**：通过"), ("a", "03_audit_report.md", "**判决**：好"), ("c", "10_review.md", "**判决**：x")], "case_key string, file string, text string")
    more = claims.unionByName(spark.createDataFrame([(9, "C-001", "e", "E", "R1")], claims.schema))
    reports, problems = op.bundles(more, edges, spark.createDataFrame(maps, "case_key string, manifest string"), reviews, "2026-01-01")
    assert {(r["case_key"], r["manifest"], r["problem"]) for r in problems.collect() if r["case_key"] != "f"} == {("c", "claims", "illegal claim_class"), ("e", "evidence", "no source manifest")}
    got = {(r["case_key"], r["report"]): json.loads(r["json"]) for r in reports.collect()}
    assert got.keys() == {(c, r) for c in "abd" for r in op.REPORTS}
    assert got["a", "source-map"]["mapping"] == mapping["mapping"] and got["a", "evidence"] == mapping and got["d", "claims"]["claims"] == []
    assert [(x["stage"], x["verdict"]) for x in got["a", "review"]["stages"]] == [("r1 来源审计", "好"), ("r4 初稿审查", "通过")] and got["b", "review"]["stages"] == []
    path = str(tmp_path / "out")
    read = lambda: {(r["case_key"], r["run"]) for r in sinks.committed_bundles(spark, path).collect()}
    sinks.commit_bundles(reports, path, "0001")
    assert read() == {("a", "0001"), ("b", "0001"), ("d", "0001")}
    # A run that broke off before its marker isn't seen.
    reports.withColumn("run", F.lit("0002")).write.parquet(f"{path}/runs/0002")
    assert read() == {("a", "0001"), ("b", "0001"), ("d", "0001")}
    sinks.commit_bundles(reports.where("case_key = 'a'"), path, "0002")
    sinks.commit_bundles(reports.where("case_key <> 'd'"), path, "0001")
    assert read() == {("a", "0002"), ("b", "0001")}
