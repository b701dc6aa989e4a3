"""Queries over drafts and their citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as t
from attesta.operators import citations as op
from attesta.plans import bindings as b
from attesta.plans.bindings import DRAFTS_SQL
from attesta.plans.registry import query

_PARTS = f"""{DRAFTS_SQL}, parts AS (
  SELECT doc_id, text, split_part(text, chr(10) || '## 参考文献', 1) AS body, '## 参考文献' || split_part(split_part(text, chr(10) || '## 参考文献', 2), chr(10) || '## 附录A', 1) AS refs,
    '## 附录A' || split_part(text, chr(10) || '## 附录A', 2) AS appendix FROM drafts
), marks AS (
  SELECT *, list_sort(list_distinct(regexp_extract_all(body, '\\[S(\\d+)\\]', 1))) AS cited, list_sort(list_distinct(regexp_extract_all(refs, '\\[S(\\d+)\\]', 1))) AS listed,
    list_sort(list_distinct(regexp_extract_all(body, '\\[G(\\d+)\\]', 1))) AS gaps, list_sort(list_distinct(regexp_extract_all(appendix, '\\[G(\\d+)\\]', 1))) AS listed_gaps FROM parts)"""
_LINES = "list_filter(string_split(refs, chr(10)), lambda x: regexp_matches(x, '^\\[S\\d+\\]'))"


def _except(a: str, b_: str) -> str:
    return f"array_to_string(list_filter({a}, lambda x: NOT list_contains({b_}, x)), ',')"


@query("g1_citation_closure", f"""WITH {_PARTS}, x AS (SELECT doc_id, {_except('cited', 'listed')} AS orphaned, {_except('listed', 'cited')} AS unused, {_except('gaps', 'listed_gaps')} AS orphaned_gaps, {_except('listed_gaps', 'gaps')} AS unused_gaps,
  array_to_string(list_sort(list_distinct(list_transform(list_filter({_LINES}, lambda x: NOT contains(x, 'https://')), lambda x: regexp_extract(x, '^\\[(S\\d+)\\]', 1)))), ',') AS missing_urls,
  len(listed)::INT AS n_refs, length(regexp_replace(body, '[\\s\\x{{00a0}}\\x{{3000}}]', '', 'g'))::INT AS body_chars FROM marks)
SELECT *, n_refs < 3 AS few_sources, body_chars < 60 AS thin, orphaned = '' AND unused = '' AND orphaned_gaps = '' AND unused_gaps = '' AND missing_urls = '' AND n_refs >= 3 AND body_chars >= 60 AS passed FROM x""")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ("orphaned", "unused", "orphaned_gaps", "unused_gaps", "missing_urls")
    return op.closure(b.drafts(spark, sf_dir), min_sources=3, min_chars=60).select("doc_id", *[F.array_join(c, ",").alias(c) for c in lists], "n_refs", "body_chars", "few_sources", "thin", "passed")


@query("j4_orphaned", "SELECT DISTINCT l_orderkey AS doc_id, l_partkey::VARCHAR AS ref FROM lineitem WHERE l_partkey % 7 = 0 AND l_partkey <> l_orderkey % 2000")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 too."""
    return op.orphaned(b.drafts(spark, sf_dir))


@query("j4_unused", "SELECT d.doc_id, (d.doc_id % 2000)::VARCHAR AS ref FROM (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem) d ANTI JOIN lineitem l ON l.l_orderkey = d.doc_id AND l.l_partkey = d.doc_id % 2000")
def j4_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.unused(b.drafts(spark, sf_dir))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of the drafts: levels by number, and for every fifth source another title than the drafts'."""
    key = F.col("p_partkey")
    level = F.when((key % 9).isin(5, 6), "c").when(key % 9 == 4, "B").otherwise("A")
    title = F.when(key % 5 == 0, "Wholly unlike words").otherwise(F.concat(F.lit("Title "), key.cast("string")))
    return b.table(spark, sf_dir, "part").select(F.concat(F.lit("S"), key.cast("string")).alias("source_id"), level.alias("source_level"), title.alias("title"))


@query("g1_corpus_closure", """WITH e AS (SELECT l_orderkey AS doc_id, l_partkey AS s, count(*) AS n FROM lineitem GROUP BY ALL),
unlike AS (SELECT doc_id, s FROM e WHERE s % 5 = 0 AND s % 7 <> 0 UNION ALL SELECT DISTINCT doc_id, doc_id % 2000 FROM e WHERE doc_id % 2000 IN (SELECT p_partkey FROM part)),
m AS (SELECT doc_id, string_agg('S' || s, ',' ORDER BY s::VARCHAR) AS mismatched FROM unlike GROUP BY doc_id)
SELECT e.doc_id, coalesce(string_agg(CASE WHEN s % 9 IN (5, 6) AND n > 1 THEN s::VARCHAR END, ',' ORDER BY s::VARCHAR), '') AS overused, coalesce(any_value(mismatched), '') AS mismatched FROM e LEFT JOIN m ON m.doc_id = e.doc_id GROUP BY e.doc_id""")
def g1_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the gate that needs the corpus, over drafts with a blank line before each entry. The drafts' extra entry is unlike any title."""
    drafts = b.drafts(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\n(\[S\d+\])", "\n\n$1"))
    d = op.closure(drafts, sources=_levels(spark, sf_dir), threshold=1)
    return d.select("doc_id", F.array_join("overused", ",").alias("overused"), F.array_join("mismatched", ",").alias("mismatched"))


@query("a1_citation_counts", "SELECT l_orderkey AS doc_id, l_partkey::VARCHAR AS ref, count(*) AS n FROM lineitem GROUP BY ALL")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.citation_counts(b.drafts(spark, sf_dir)).drop("first")


@query("t2_top5_cited", "SELECT l_orderkey AS doc_id, l_partkey::VARCHAR AS ref, count(*) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_partkey)::INT AS rank, CASE WHEN l_partkey % 9 IN (5, 6) THEN 'C' WHEN l_partkey % 9 = 4 THEN 'B' ELSE 'A' END AS level FROM lineitem GROUP BY l_orderkey, l_partkey QUALIFY rank <= 5")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.most_cited(b.drafts(spark, sf_dir), levels=op.source_levels(_levels(spark, sf_dir))).drop("first")


@query("a15_c_level_overuse", "SELECT l_orderkey AS doc_id, l_partkey::VARCHAR AS ref, count(*) AS n FROM lineitem WHERE l_partkey % 9 IN (5, 6) GROUP BY ALL HAVING count(*) > 1")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17 too."""
    return op.overused(b.drafts(spark, sf_dir), op.source_levels(_levels(spark, sf_dir)), threshold=1).drop("first")


@query("p6_markers", f"WITH {_PARTS} SELECT doc_id, array_to_string(cited, ',') AS cited, array_to_string(listed, ',') AS listed, array_to_string(gaps, ',') AS gaps FROM marks")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P7 too."""
    d = op.split_drafts(b.drafts(spark, sf_dir))
    return d.select("doc_id", *[F.array_join(op.markers(c, m), ",").alias(a) for c, m, a in (("body", t.SOURCE_MARK, "cited"), ("refs", t.SOURCE_MARK, "listed"), ("body", t.GAP_MARK, "gaps"))])


@query("f24_missing_urls", f"WITH {_PARTS} SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter({_LINES}, lambda x: NOT contains(x, 'https://')), lambda x: regexp_extract(x, '^\\[(S\\d+)\\]', 1)))), ',') AS tags FROM marks")
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 too."""
    return op.split_drafts(b.drafts(spark, sf_dir)).select("doc_id", F.array_join(op.entries_without_url(F.col("refs")), ",").alias("tags"))


@query("j12_gap_semi", "SELECT DISTINCT l_orderkey AS doc_id, n::VARCHAR AS gap FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM lineitem GROUP BY ALL) WHERE l_partkey % 20 = 0")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of the appendix that the body cites."""
    d = op.split_drafts(b.drafts(spark, sf_dir))
    rows = lambda c: d.select("doc_id", F.explode(op.markers(c, t.GAP_MARK)).alias("gap"))
    return rows("appendix").join(rows("body"), ["doc_id", "gap"], "left_semi")


_NUMBERS = """ord AS MATERIALIZED (SELECT doc_id, s AS key, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS pos FROM one WHERE s % 7 <> 0),
keys AS (SELECT doc_id, key, pos FROM ord UNION ALL SELECT d.doc_id, d.doc_id % 2000, 1000000 FROM (SELECT DISTINCT doc_id FROM one) d ANTI JOIN ord o ON o.doc_id = d.doc_id AND o.key = d.doc_id % 2000),
numbers AS MATERIALIZED (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM keys)"""


@query("w2_number_map", f"WITH {DRAFTS_SQL}, {_NUMBERS} SELECT doc_id, key::VARCHAR AS key, n FROM numbers")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P33, T4 too."""
    d = op.split_drafts(b.drafts(spark, sf_dir))
    return d.select("doc_id", F.posexplode(op.number_map(F.col("refs"))).alias("n", "key")).select("doc_id", "key", (F.col("n") + 1).cast("long").alias("n"))


_FINAL = f"""{DRAFTS_SQL}, {_NUMBERS}, bodies AS (
  SELECT o.doc_id, '# Draft ' || o.doc_id || chr(10) || chr(10) || string_agg('Item ' || s || ' holds ' || repeat(coalesce('[' || n.n || '] ', '[?' || s || '] '), times) || CASE WHEN s % 10 = 0 THEN ' ' ELSE '' END || ' here.', chr(10) ORDER BY s) AS body,
    string_agg(CASE WHEN s % 20 = 0 THEN chr(10) || o.n || '. gap of ' || s ELSE '' END, '' ORDER BY s) AS gaps,
    string_agg(CASE WHEN s % 7 <> 0 THEN '[' || n.n || '] Title ' || s || CASE WHEN s % 11 <> 0 THEN '. https://x.org/' || (s % 50) ELSE '.' END || chr(10) ELSE '' END, '' ORDER BY s) AS refs
  FROM one o LEFT JOIN numbers n ON n.doc_id = o.doc_id AND n.key = o.s GROUP BY o.doc_id
), finals AS MATERIALIZED (
  SELECT b.doc_id, body || CASE WHEN gaps <> '' THEN chr(10) || chr(10) || '## 研究局限' || chr(10) || chr(10) || '本文基于已审计公开来源展开，以下方面因证据可得性与范围限制未予充分展开，有待后续工作补充：' || chr(10) || gaps ELSE '' END
    || chr(10) || chr(10) || '## 参考文献' || chr(10) || refs || '[' || x.n || '] Extra. https://x.org/extra' || chr(10) AS final, refs || '[' || x.n || '] Extra. https://x.org/extra' AS ref_lines, body
  FROM bodies b JOIN numbers x ON x.doc_id = b.doc_id AND x.key = b.doc_id % 2000)"""


@query("p34_finished_text", f"WITH {_FINAL} SELECT doc_id, final FROM finals")
def p34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P35, P36 too."""
    return op.finished(b.drafts(spark, sf_dir)).select("doc_id", "final")


_ORDER = "list_transform(regexp_extract_all(ref_lines, '\\[(\\d+)\\] ', 1), lambda x: x::INT)"


@query("g7_residuals", f"""WITH {_FINAL}, urls AS (SELECT doc_id, unnest(regexp_extract_all(ref_lines, 'https?://[^\\s\\]]+')) AS u FROM finals)
SELECT doc_id, 'residual [?n]: ' || len(regexp_extract_all(final, '\\?\\d+\\]')) AS problem FROM finals WHERE regexp_matches(final, '\\?\\d+\\]')
UNION ALL SELECT doc_id, 'numbering' FROM finals WHERE {_ORDER} <> range(1, len({_ORDER}) + 1)
UNION ALL SELECT doc_id, 'duplicate URL: ' || u FROM (SELECT doc_id, u, unnest(range(count(*) - 1)) FROM urls GROUP BY doc_id, u)""")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F25, A5 too."""
    return op.final_problems(op.finished(b.drafts(spark, sf_dir)))


@query("g2_numeric_closure", f"""WITH {_FINAL}, x AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(body, '\\[(\\d+)\\]', 1), lambda y: y::INT))) AS cited, list_sort(list_distinct({_ORDER})) AS listed FROM finals)
SELECT doc_id, {_except('cited', 'listed')} AS orphaned, {_except('listed', 'cited')} AS unused, {_except('range(1, list_max(listed) + 1)', 'listed')} AS gaps, len(listed)::INT AS n_refs, len(listed) < 3 AS few_sources, cited = listed AND len(listed) = list_max(listed) AND len(listed) >= 3 AS passed FROM x""")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, W3 too, over the finished texts."""
    d = op.numeric_closure(op.finished(b.drafts(spark, sf_dir)).select("doc_id", F.col("final").alias("text")), min_sources=3)
    return d.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("orphaned", "unused", "gaps")], "n_refs", "few_sources", "passed")


@query("w3_sequence_gaps", "SELECT l_orderkey AS doc_id, array_to_string(list_filter(range(1, max(l_linenumber) + 1), lambda x: NOT list_contains(list(l_linenumber), x::INT)), ',') AS gaps FROM lineitem GROUP BY l_orderkey")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set("l_linenumber").alias("xs"))
    return d.select("doc_id", F.array_join(F.array_except(F.sequence(F.lit(1), F.array_max("xs")), "xs"), ",").alias("gaps"))


@query("p37_changes", f"WITH {DRAFTS_SQL} SELECT doc_id, len(regexp_extract_all(text, '\\[S\\d+\\]'))::INT AS marks, len(regexp_extract_all(text, '\\[假设\\]'))::INT AS tags, len(regexp_extract_all(text, '\\[G\\d+\\]'))::INT AS gaps_before, 0 AS gaps_after FROM drafts")
def p37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.changes(b.drafts(spark, sf_dir))


@query("a18_marker_totals", f"WITH {DRAFTS_SQL} SELECT doc_id, len(regexp_extract_all(text, '\\[S\\d+\\]'))::INT AS s, len(regexp_extract_all(text, '\\[G\\d+\\]'))::INT AS g, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS round_s, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS round_g, len(string_split(text, chr(10)))::INT AS lines FROM drafts")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of review rounds are counted by themselves."""
    d = b.drafts(spark, sf_dir).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " [R1-S2] [R2-S10] [R1-G3]").otherwise("")))
    return d.select("doc_id", *[x.alias(n) for n, x in op.marker_totals(F.col("text")).items()])


@query("w7_boundaries", f"WITH {DRAFTS_SQL}, x AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM drafts) SELECT doc_id, (list_position(lines, '## 参考文献') - 1)::INT AS refs, (list_position(lines, '## 附录A 缺口') - 1)::INT AS appendix FROM x")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.drafts(spark, sf_dir)
    return d.select("doc_id", F.array_min(t.lines_where(F.col("text"), op.REFS_FIRST)).alias("refs"), F.array_max(t.lines_where(F.col("text"), op.APPENDIX_LAST)).alias("appendix"))


@query("l22_invariance", f"WITH {DRAFTS_SQL} SELECT doc_id FROM drafts WHERE doc_id % 3 = 0")
def l22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit that loses a marker in every third draft, and only words in the others."""
    d = b.drafts(spark, sf_dir)
    edited = d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" [S1]"))).otherwise(F.replace(F.col("text"), F.lit("holds"), F.lit("has"))))
    return op.invariant(d, edited)


@query("l12_gates", f"""WITH {_FINAL}, {_PARTS.replace(DRAFTS_SQL + ", ", "")}, c AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(body, '\\[(\\d+)\\]', 1), lambda y: y::INT))) AS cited, list_sort(list_distinct({_ORDER})) AS listed FROM finals),
urls AS (SELECT doc_id, count(*) <> count(DISTINCT u) AS again FROM (SELECT doc_id, unnest(regexp_extract_all(ref_lines, 'https?://[^\\s\\]]+')) AS u FROM finals) GROUP BY doc_id),
audit AS (SELECT o_orderkey AS doc_id, o_orderpriority[1] IN ('1', '2') OR o_custkey % 8 = 2 AS risky FROM orders),
lost AS (SELECT DISTINCT l_orderkey AS doc_id FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_returnflag DESC, l_linestatus DESC) = 1)
  WHERE l_returnflag || l_linestatus <> 'RF' AND NOT (l_linenumber = 5 OR (l_linenumber % 2 = 0 AND l_quantity::INT <> 0))),
x AS (SELECT f.doc_id, NOT regexp_matches(final, '\\?\\d+\\]') AS residuals, c.cited = c.listed AND len(c.listed) >= 3 AS closure, len(c.listed) = list_max(c.listed) AS sequence, coalesce(again, false) AS again,
  m.cited = m.listed AND m.gaps = m.listed_gaps AND len(list_filter({_LINES.replace("refs", "m.refs")}, lambda x: NOT contains(x, 'https://'))) = 0 AS working, len(m.listed) >= 3 AND length(regexp_replace(m.body, '[\\s\\x{{00a0}}\\x{{3000}}]', '', 'g')) >= 60 AS minimum,
  f.doc_id % 3 <> 0 OR NOT coalesce(risky, false) OR f.doc_id NOT IN (SELECT doc_id FROM lost) AS audited, f.doc_id % 3 = 0 AS of_case, f.doc_id NOT IN (SELECT o_orderkey FROM orders) AS unheard
  FROM finals f JOIN c USING (doc_id) JOIN marks m ON m.doc_id = f.doc_id LEFT JOIN urls u ON u.doc_id = f.doc_id LEFT JOIN audit a ON a.doc_id = f.doc_id)
SELECT doc_id, residuals AS a, closure AND sequence AS b, working AND minimum AND audited AND NOT (of_case AND unheard) AS c, NOT again AS d, residuals AND closure AND sequence AND working AND minimum AND audited AND NOT again AND NOT (of_case AND unheard) AS released FROM x""")
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates A to D in one plan; every third draft is a case's and needs the audit of its claim."""
    from attesta.operators import claims as claims_op
    from attesta.operators import final_gate

    drafts = b.drafts(spark, sf_dir)
    audited = claims_op.auditability(b.claims(spark, sf_dir), b.evidence(spark, sf_dir)).select(F.col("claim_key").alias("doc_id"), (F.col("auditable") | ~F.col("high_risk")).alias("ok")).where("doc_id % 3 = 0")
    rows = [final_gate.delivery_rows(drafts, 3, 60), final_gate.case_rows(final_gate.case_verdicts("audit", audited, F.col("ok")))]
    docs = drafts.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("case"))).alias("kinds"))
    return final_gate.released_rows(docs, rows, by_kind={"case": (("C", "audit"),)}).drop("failing")
