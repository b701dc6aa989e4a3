"""Queries of routes and narratives: every part is a document with a route, every order one with prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import narratives as narrative_op
from attesta.operators import routes as op
from attesta.plans import bindings as b
from attesta.plans.registry import query


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six activities under their layers; some parts lack one, or a heading, have a fourth level, a cycle, or as many solutions as activities only by chance.

    Rows are short and routes are long: the rows are dealt out first.
    """
    key, size = F.col("p_partkey"), F.col("p_size")
    say = lambda when, x, other="": F.when(when, F.lit(x)).otherwise(F.lit(other))
    diagram = F.concat(
        F.lit('flowchart TD\nA["总目标：课题"] --> B[输入层：数据]\nB --> C[问题层：难点] -->|then| D[技术层：方向]\n'), say(size % 2 == 0, "subgraph one\nend\nsubgraph two\nend\nsubgraph three\nend\n"), say(size % 14 == 0, "subgraph four\nend\n"),
        F.lit("C --> C1[难题一] & C2[难题二]\n"), say(key % 5 != 0, "C --> C3[难题三]\n"), F.lit("D --> D1[技术一] & D2[技术二] & D3[技术三 待补证]\n"), say(key % 7 == 0, "X[环甲] --> Y[环乙]\nY --> X\n"), say(key % 11 == 0, "D1 --> E[\"成果[S4]\"]\n"),
    )
    heads = F.concat(F.lit("# 课题\n## 1. 数据\n## 2. 难点\n## 3. 方向\n### 3.1 难题一\n### 3.2 难题二\n### 3.3 难题三\n### 3.4 技术一\n"), say(key % 3 != 0, "### 3.5 技术二\n"), F.lit("### 3.6 技术三\n# 环甲\n# 环乙\n# 成果[S4]\n"), say(key % 13 != 0, "[G1] 技术三 没有数据\n"))
    solutions = F.repeat(F.lit("### 解\n"), F.when(key % 17 == 0, 5).otherwise(6))
    p = b.table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism)
    return p.select(key.alias("doc_id"), F.concat(heads, F.lit("```mermaid\n"), diagram, F.lit("```\n## 5. 关键技术问题与解决方案\n"), solutions, F.lit("## 6. 末\n### 外\n")).alias("text"))


@query("l14_route_lock", """WITH x AS (SELECT p_partkey AS doc_id, p_size % 2 = 0 AS sub, p_size % 14 = 0 AS four, p_partkey AS k FROM part)
SELECT doc_id, (9 + (k % 5 <> 0)::INT + 2 * (k % 7 = 0)::INT + (k % 11 = 0)::INT)::INT AS n_nodes, CASE WHEN four THEN 4 WHEN sub THEN 3 WHEN k % 11 = 0 THEN 6 ELSE 5 END::INT AS depth, (2 + (k % 5 <> 0)::INT)::INT AS problems, 3::INT AS technologies,
  CASE WHEN k % 17 = 0 THEN 5 ELSE 6 END::INT AS solutions, CASE WHEN k % 3 = 0 THEN '技术二' ELSE '' END AS unheaded, CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END::INT AS citing, CASE WHEN k % 13 = 0 THEN '技术三' ELSE '' END AS hidden, CASE WHEN k % 7 = 0 THEN 'X,Y' ELSE '' END AS cyclic,
  sub AND NOT four AND k % 5 <> 0 AND k % 17 <> 0 AND k % 3 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AND k % 7 <> 0 AS passed FROM x""")
def l14(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op.route_lock(_routes(spark, sf_dir))
    joined = lambda x: F.array_join(x, ",")
    return d.select("doc_id", "n_nodes", "depth", "problems", "technologies", "solutions", joined("unheaded").alias("unheaded"), F.size("citing").alias("citing"), joined("hidden_gaps").alias("hidden"), joined("cyclic").alias("cyclic"), "passed")


@query("l14_levels", """WITH RECURSIVE e AS (SELECT p_partkey AS doc_id, unnest([['A', 'B'], ['B', 'C'], ['C', 'D'], ['C', 'C1'], ['C', 'C2'], ['D', 'D1'], ['D', 'D2'], ['D', 'D3']] || CASE WHEN p_partkey % 5 <> 0 THEN [['C', 'C3']] ELSE [] END
  || CASE WHEN p_partkey % 7 = 0 THEN [['X', 'Y'], ['Y', 'X']] ELSE [] END || CASE WHEN p_partkey % 11 = 0 THEN [['D1', 'E']] ELSE [] END) AS p FROM part),
walk AS (SELECT DISTINCT doc_id, 'A' AS id, 1 AS level FROM e UNION SELECT w.doc_id, p[2], level + 1 FROM walk w JOIN e ON e.doc_id = w.doc_id AND p[1] = w.id)
SELECT e.doc_id, p[1] AS src, p[2] AS dst, min(level)::INT AS level FROM e LEFT JOIN walk w ON w.doc_id = e.doc_id AND w.id = p[1] GROUP BY ALL""")
def l14_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.edge_table(_routes(spark, sf_dir))


@query("l6_narratives", """WITH s AS (SELECT l_orderkey AS doc_id, row_number() OVER w - 1 AS i, l_returnflag || l_linestatus AS f, l_linenumber FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity)),
k AS (SELECT doc_id, i, CASE f[1] WHEN 'A' THEN 'P' WHEN 'N' THEN CASE WHEN f[2] = 'O' THEN 'S' ELSE 'V' END ELSE CASE WHEN f[2] = 'F' THEN 'O' ELSE 'F' END END AS t FROM s),
n2 AS (SELECT a.doc_id, 'N2' AS pattern, a.i AS first, b.i AS last FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.i > a.i + 1 AND a.t = 'S' AND b.t = 'V' WHERE NOT EXISTS (SELECT 1 FROM k c WHERE c.doc_id = a.doc_id AND c.i > a.i AND c.i < b.i AND c.t <> 'O'))
SELECT doc_id, pattern, first::INT AS first, last::INT AS last FROM n2""")
def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as sentences; cited growth, inferences without a source, then a conclusion of worth without one."""
    said = F.when(F.col("l_returnflag") == "A", "传统方法效率低。").when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "O", "市场增长[S1]。").otherwise("价值巨大。")).otherwise(F.when(F.col("l_linestatus") == "F", "本项目因此好。").otherwise("趋势明朗。"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", said.alias("t"))
    docs = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]), "").alias("text"))
    return narrative_op.narratives(docs).where(F.col("pattern") == "N2").select("doc_id", "pattern", "first", "last")


@query("l6_journeys", """WITH s AS (SELECT o_custkey AS doc_id, CASE o_orderpriority[1] WHEN '1' THEN 'P' WHEN '2' THEN 'O' WHEN '3' THEN 'F' ELSE '.' END AS t, o_orderkey FROM orders),
d AS (SELECT doc_id, string_agg(t || ';', '' ORDER BY o_orderkey) AS tokens FROM s GROUP BY doc_id)
SELECT doc_id, len(regexp_extract_all(tokens, 'P;([POF.];){0,3}?O;([POF.];){0,3}?F')) AS journeys FROM d WHERE regexp_matches(tokens, 'P;([POF.];){0,3}?O;([POF.];){0,3}?F')""")
def l6_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as sentences: an old way, one's own project and a future, in this order, near each other."""
    said = F.when(F.col("o_orderpriority").startswith("1"), "传统方法慢。").when(F.col("o_orderpriority").startswith("2"), "本项目快。").when(F.col("o_orderpriority").startswith("3"), "未来好。").otherwise("说明。")
    docs = b.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", said.alias("t")))), lambda x: x["t"]), "").alias("text"))
    return narrative_op.narratives(docs).where(F.col("pattern") == "N1").groupBy("doc_id").agg(F.count("*").alias("journeys"))
