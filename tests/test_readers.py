"""Readers over files with odd entries."""

import json

from attesta.sources import readers


def write(path, **files):
    for name, data in files.items():
        (path / f"{name}.json").write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_corpus_keeps_what_stands_beside_odd_entries(spark, tmp_path):
    path = write(tmp_path, a={"sources": [{"source_id": "S1", "year": 2020}, "odd", None, {"source_id": "S2", "title": ["x"]}], "items": [{"title": "no id"}]}, b=[{"source_id": "S3"}, 7], c="{broken", d="5", e="﻿" + json.dumps({"core_sources": [{"id": "x", "source_id": "S4"}]}), f={"sources": "none"})
    got = {(r["file"][-6:-5], r["pos"]): (r["source_id"], r["year"], r["title"]) for r in readers.corpus(spark, path).collect()}
    assert got == {("a", 0): ("S1", "2020", None), ("a", 3): ("S2", None, '["x"]'), ("a", 4): (None, None, "no id"), ("b", 0): ("S3", None, None), ("e", 0): ("S4", None, None)}
    odd = {(r["file"][-6:-5], r["pos"], r["problem"]) for r in readers.entry_problems(spark, path).collect()}
    assert odd == {("a", 1, "entry is no object"), ("a", 2, "entry is no object"), ("b", 1, "entry is no object"), ("c", None, "no JSON"), ("d", None, "root is neither object nor list")}


def listed(obj):
    """The sources of a tree in order, by recursion."""
    if isinstance(obj, dict):
        if "id" in obj or "source_id" in obj:
            yield obj
        for key in readers.SOURCE_LISTS:
            for x in obj[key] if isinstance(obj.get(key), list) else ():
                if isinstance(x, dict):
                    yield from listed(x)
    elif isinstance(obj, list):
        for x in obj:
            yield from listed(x)


def test_sources_at_any_depth(spark, tmp_path):
    deep = {"id": "bottom"}
    for i in range(20):
        deep = {"items" if i % 3 else "sources": [deep, i, [{"id": "in a list"}]]} | ({"id": i} if i % 2 else {})
    for i in range(12):
        deep = [[deep], {"id": f"x{i}", "supporting_sources": [{"source_id": None}, "odd"]}]
    trees = {"a": deep, "b": [{"id": 1, "sources": [{"id": 2}, {"title": "none", "items": [{"id": 3}]}]}, "x", None], "c": {"other": [{"id": 9}]}, "d": [], "e": 3}
    path = write(tmp_path, **trees)
    rows = sorted(((r["file"][-6:-5], r["place"], json.loads(r["source"])) for r in readers.nested_sources(spark, path).collect()), key=lambda r: r[:2])
    got = {x: [s for f, _, s in rows if f == x] for x in trees}
    assert got == {x: list(listed(t)) for x, t in trees.items()} and len(got["a"]) > 25


def test_evidence_map_with_odd_entries(spark, tmp_path):
    claims = [
        {"claim_to_write": "a", "risk": "R2", "source_support_levels": {"S1": "direct", "S2": "contradictory"}, "source_locators": {"S1": {"page": "x", "section": "2"}, "S2": "p. 3", "S3": {}}},
        "odd", {"claim_to_write": "b", "source_support_levels": ["S1"], "source_relations": 5}, None, {"claim_to_write": "c", "source_support_levels": {"S9": "weak_inference"}, "source_locators": {"S9": {"page": None}}},
    ]
    path = write(tmp_path, a={"evidence_map": claims})
    c, e = readers.claims_and_edges(readers.evidence_map(spark, path))
    assert {(r["claim_id"], r["claim_text"], r["risk"]) for r in c.collect()} == {("C-001", "a", "R2"), ("C-003", "b", "R1"), ("C-005", "c", "R1")}
    edges = {(r["claim_key"][-5:], r["source_id"]): (r["support_level"], r["relation"], r["page"], r["section"], r["recorded"]) for r in e.collect()}
    assert edges == {("C-001", "S1"): ("direct", "supports", None, "2", True), ("C-001", "S2"): ("contradictory", "contradicts", None, None, False), ("C-005", "S9"): ("weak_inference", "supports", None, None, True)}
    assert [r["pos"] for r in readers.entry_problems(spark, path, ("evidence_map",)).orderBy("pos").collect()] == [1, 3]
