"""Layered rules as data against a plain merge."""

import json
import random

from pyspark.sql import functions as F

from attesta.operators import rule_layers as op
from attesta.plans import rules


def plain(base, over):
    if not (isinstance(base, dict) and isinstance(over, dict)):
        return over
    return {x: plain(base[x], over[x]) if x in base and x in over else over.get(x, base.get(x)) for x in {**base, **over}}


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, 2.5, "x", 'q"\\é', True, None, [], [1, {"a": 2}], {}])
    return {k: tree(rng, depth - 1) for k in rng.sample(["a", "b", "c", "d e", 'k"'], rng.randint(0, 4))}


def resolved(spark, layers, cases):
    d, members, problems = op.resolve(spark.createDataFrame(layers, "case_key long, layer int, doc string"), spark.createDataFrame(cases, "case_key long, profile string"))
    built = members.join(op.trees(d), "set_key", "left")
    return {r["case_key"]: json.loads(r["rules"]) if r["rules"] else None for r in built.collect()}, {r["case_key"]: r["problem"] for r in problems.collect()}, d, members


def test_merge_like_nested_maps(spark):
    """Random trees of objects, lists, nulls and empty objects, over three layers and a profile."""
    rng, layers, cases, want = random.Random(3), [], [], {}
    for case in range(60):
        docs = [{k: tree(rng, 3) for k in rng.sample("abc", 2)} for _ in range(rng.randint(1, 3))]
        profile = None
        if case % 3 == 0:
            docs[0]["scenario_profiles"] = {"p": {k: tree(rng, 3) for k in rng.sample("abc", rng.randint(0, 3))}, "q": {"a": {"a": 1}}}
            profile = "p"
        layers += [(case, i, json.dumps(x)) for i, x in enumerate(docs)]
        cases.append((case, profile))
        w = docs[0]
        for x in docs[1:]:
            w = plain(w, x)
        want[case] = plain(plain(w, w["scenario_profiles"]["p"]), {"active_profile": "p"}) if profile else w
    got, problems, *_ = resolved(spark, layers, cases)
    assert not problems and got == want


def test_profiles_of_many_cases(spark):
    base = op.default_layer()
    layers = [(i, 0, base) for i in range(7)] + [(4, 1, json.dumps({"doc_minimums": {"proposal": {"min_sources": 99}}, "evidence_sufficiency": {"R1": {"min_primary_sources": 3}}})), (5, 1, "[1]"), (6, 1, "{}"), (6, 1, "{}")]
    cases = [(0, None), (1, "medical"), (2, "general_tech"), (3, "nowhere"), (4, " "), (5, None), (6, None), (8, None)]
    got, problems, d, members = resolved(spark, layers, cases)
    assert got[0] == json.loads(json.dumps(rules.load_rules())) and got[8] is None
    for case, profile in ((1, "medical"), (2, "general_tech")):
        assert got[case] == json.loads(json.dumps(rules.load_rules(profile=profile))) | {"active_profile": profile}
    assert problems.keys() == {3, 5, 6} and problems[3].startswith("unknown profile nowhere; available: general_tech, journal_top, medical")
    by = lambda t: {(r["case_key"], *[r[x] for x in t.columns if x != "set_key"][:1]): r for r in members.join(t, "set_key").collect()}
    floors, minimums, tiers = by(op.floors(d)), by(op.minimums(d)), by(op.tiers(d))
    assert (floors[0, "R3"]["floor"], floors[1, "R3"]["floor"], floors[2, "R3"]["floor"]) == ("A2", "A1", "B1") and (0, "R0") not in floors
    assert (minimums[4, "proposal"]["min_sources"], minimums[4, "proposal"]["min_chars"], minimums[1, "report_survey"]["min_sources"]) == (99, 6000, 30)
    assert (tiers[4, "R1"]["primary"], tiers[4, "R1"]["independent"], tiers[0, "R4"]["primary"], tiers[0, "R4"]["live"]) == (3, 1, 2, True)
    extra = spark.createDataFrame([(1, ["x.org", "zhihu.com"])], "case_key long, domains array<string>")
    domains = {r["case_key"]: tuple(r["domains"]) for r in op.suspect_domains(d, members, extra).collect()}
    assert domains[1] == rules.effective_suspect_domains(rules.load_rules(profile="medical"), ["x.org", "zhihu.com"]) and domains[0] == rules.effective_suspect_domains(rules.load_rules()) and domains[8] == ()


def test_floors_by_case(spark):
    layers = [(i, 0, op.default_layer()) for i in (1, 2)]
    _, _, d, members = resolved(spark, layers, [(1, "medical"), (2, "general_tech")])
    claims = spark.createDataFrame([(10, 1, "R3", "E"), (20, 2, "R3", "E"), (30, 3, "R4", "E")], "claim_key long, case_key long, risk string, claim_class string")
    sources = spark.createDataFrame([(1, "B1", "current", "u"), (2, "A1", "current", "u")], "source_key long, authority string, freshness string, url string")
    edges = spark.createDataFrame([(c, s, "supports") for c in (10, 20, 30) for s in (1, 2)], "claim_key long, source_key long, relation string")
    low = {(r["claim_key"], r["source_key"]) for r in op.below_floor(claims, sources, edges, members, op.floors(d)).collect()}
    # A1 is asked for in one case, B1 in the other; a case without rules asks for nothing.
    assert low == {(10, 1)}
    needs = {r["claim_key"]: (r["need_primary"], r["need_independent"], r["need_live"]) for r in op.sufficiency_needs(claims, members, op.tiers(d), 1.5).collect()}
    assert needs == {10: (2, 3, True), 20: (2, 3, True), 30: (0, 2, False)}


def test_ranking_file(spark):
    doc = json.dumps({"default_by_category": {"x": {"authority": "B1", "priority": 70, "role": ["core"]}}, "sources": {"s2": {"priority": 90}, "s3": {"authority": "A1", "priority": 0}}})
    registry = spark.createDataFrame([("s1", "x"), ("s2", "x"), ("s3", "y"), ("s4", None)], "id string, category string")
    got = {r["id"]: (r["authority"], r["priority"], r["role"]) for r in op.ranking(spark.createDataFrame([(doc,)], "doc string"), registry).collect()}
    assert got == {"s1": ("B1", 70, ["core"]), "s2": ("B1", 90, ["core"]), "s3": ("A1", 50, []), "s4": ("", 50, [])}


def test_nothing(spark):
    got, problems, *_ = resolved(spark, [], [])
    assert got == {} and problems == {}
    assert op.trees(spark.createDataFrame([], "set_key string, path array<string>, value string")).where(F.lit(True)).count() == 0
