"""Routes and narratives on small texts."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import narratives, routes

LAYERS = ["输入层：数据", "问题层：难点", "技术层：方向", "验证层：试验", "成果层：交付"]


def route(problems=3, technologies=3, solutions=6, extra="", subgraphs=3, skip=(), mark=""):
    acts = [f"问题{i}" for i in range(problems)] + [f"技术{i}" for i in range(technologies)]
    lines = ["flowchart TD", '  A["总目标：课题"]'] + [f"subgraph L{i}\nend" for i in range(subgraphs)] + [f'  {x}["{y}"]' for x, y in zip("BCDEF", LAYERS, strict=True)]
    lines += ["  A --> B -->|接着| C", "C-->D", "D --> E & F"] + [f'C --> C{i}["问题{i}{mark}"]' for i in range(problems)] + [f"D -.-> D{i}[技术{i}]" for i in range(technologies)] + [extra]
    heads = ["# 课题", *(f"## {i + 1}. {x.split('：')[1]}" for i, x in enumerate(LAYERS)), *(f"### 1.{i} {x}" for i, x in enumerate(acts) if x not in skip)]
    body = "## 5. 关键技术问题与解决方案\n" + "\n".join(f"### 5.{i} 解{i}" for i in range(solutions)) + "\n## 6. 末\n### 不计\n"
    return "```mermaid\n" + "\n".join(lines) + "\n```\n" + "\n".join(heads) + "\n" + body


def locked(spark, **texts):
    d = spark.createDataFrame([(x, y) for x, y in texts.items()], "doc_id string, text string")
    return {r["doc_id"]: r for r in routes.route_lock(d).collect()}


def test_route_lock(spark):
    got = locked(
        spark, good=route(), two=route(problems=2, solutions=5), few=route(solutions=5), deep=route(subgraphs=4), head=route(skip=("技术1",)), cite=route(extra='F --> F1["成果[S3]"]'), cycle=route(extra="X --> Y\nY --> X"),
        hidden=route(mark=" 待补证"), shown=route(mark=" 待补证") + "\n[G1] 问题0 缺\n[G2] 问题1 缺 问题2 缺", none="# 课题\n", null=None,
    )
    assert got["good"]["passed"] and (got["good"]["n_nodes"], got["good"]["depth"], got["good"]["problems"], got["good"]["technologies"], got["good"]["solutions"]) == (12, 3, 3, 3, 6)
    assert got["two"]["problems"] == 2 and not got["two"]["passed"] and got["few"]["solutions"] == 5 and not got["few"]["passed"]
    assert got["deep"]["depth"] == 4 and not got["deep"]["passed"]
    assert got["head"]["unheaded"] == ["技术1"] and not got["head"]["passed"]
    assert got["cite"]["citing"] == ["成果[S3]"] and not got["cite"]["passed"]
    assert got["cycle"]["cyclic"] == ["X", "Y"] and not got["cycle"]["passed"]
    assert got["hidden"]["hidden_gaps"] == ["问题0", "问题1", "问题2"] and got["shown"]["passed"]
    assert got["none"]["n_nodes"] is None and not got["none"]["passed"] and not got["null"]["passed"]


def test_levels(spark):
    text = "```mermaid\ngraph TD\nA[a] --> B[b] --> C[c]\nC --> A1\nB --> D\nD --> B\nA --> C\nX --> X\nP --> Q --> R --> P\n```"
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    x = routes.diagrams(d).select(routes.levels(F.col("nodes"), F.col("edges")).alias("l")).first()["l"]
    assert {n["id"]: n["level"] for n in x} == {"A": 1, "B": 2, "C": 2, "D": 3, "A1": 3, "X": 1}
    edges = {(r["src"], r["dst"]): r["level"] for r in routes.edge_table(d).collect()}
    assert edges[("D", "B")] == 3 and edges[("P", "Q")] is None and len(edges) == 10
    # Without subgraphs the depth is that of the edges.
    assert routes.route_lock(d).first()["depth"] == 3


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("传统方法不足[S1]。本项目提出方案。未来广泛应用。", [("N1", 0, 2)]), ("未来好。本项目好。传统方法差。", []), ("传统方法差，本项目好，前景广。", [("N1", 0, 0)]),
        ("传统方法差。一。二。三。本项目好。趋势。", [("N1", 0, 5)]), ("传统方法差。一。二。三。四。本项目好。趋势。", []), ("传统方法差。\n\n本项目好。未来。", []),
        ("市场增长[S2]。本领域必然受益。项目价值巨大。", [("N2", 0, 2)]), ("市场增长[S2]。本领域因此受益[S3]。价值巨大。", []), ("市场增长[S2]。因此受益。价值巨大[假设]。", []), ("前言。增长[S2]。因此好。从而好。意义大。尾。", [("N2", 1, 4)]),
        ("项目将必然形成产业。", [("N3", 0, 0)]), ("若条件成立，项目将必然形成产业。", []), ("一。成果必将全面改变未来。二。", [("N3", 1, 1)]), ("成果已发布。", []),
        ("只有本法可行。", [("N4", 0, 0)]), ("只有本法可行。\n\n| a | b |\n", []), ("", []), ("| 只有 | 唯一 |\n# 必须\n", []),
    ],
)
def test_narratives(spark, text, want):
    d = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    got = sorted((r["pattern"], r["first"], r["last"]) for r in narratives.narratives(d).collect() if r["pattern"] in {x[0] for x in want} or not want)
    assert got == sorted(want)


def test_patterns_of_ones_own(spark):
    d = spark.createDataFrame([(1, "a。b。a。c。b。")], "doc_id int, text string")
    got = narratives.row_patterns(d, {"A": "a", "B": "b"}, {"AB": ("A;B;", "low")}).collect()
    assert [(r["first"], r["last"], r["excerpt"], r["risk"]) for r in got] == [(0, 1, "a。b。", "low")]


def test_route_lock_takes_a_text_apart_once(spark):
    """Within lambdas the diagram was cut out of the whole text again for each heading, node and edge."""
    long = route(extra="\n".join(f"D{i % 3} --> N{i}[节点{i} 待补证]" for i in range(200))) + "\n".join(f"## {i}. 节点{i}\n[G{i}] 节点{i} 缺" for i in range(2000))
    got = locked(spark, long=long)["long"]
    assert got["n_nodes"] == 212 and got["hidden_gaps"] == [] and got["solutions"] == 6 and got["depth"] == 3
    plan = routes.route_lock(spark.createDataFrame([("a", long)], "doc_id string, text string").repartition(2))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("```mermaid") <= 2, plan.count("```mermaid")
