"""Queries of export transforms over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import export as op
from attesta.plans import bindings as b
from attesta.plans.registry import query

#: Pages with their own URL in the text, in an attribute, and twice within a list of references.
_PAGE_SQL = """pages_ AS (SELECT page_id, html || '<p title="' || url || '">see ' || url || ', or <a href=''' || url || '''>' || url || '</a></p><h2 id="r">9. 参考文献</h2><p>[1] ' || url || '</p><h2>附录</h2>' || url || '</body>' AS html FROM pages)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    html = F.concat("html", F.lit('<p title="'), u, F.lit('">see '), u, F.lit(", or <a href='"), u, F.lit("'>"), u, F.lit('</a></p><h2 id="r">9. 参考文献</h2><p>[1] '), u, F.lit("</p><h2>附录</h2>"), u, F.lit("</body>"))
    return b.table(spark, sf_dir, "pages").select("page_id", html.alias("html"))


@query("p39_linkify", rf"""WITH {_PAGE_SQL}, x AS (SELECT page_id, html, regexp_split_to_array(html, '<[^>]+>') AS texts, regexp_extract_all(html, '<[^>]+>') AS tags FROM pages_),
y AS (SELECT page_id, html, array_to_string(list_transform(range(1, len(texts) + 1), lambda i: CASE WHEN texts[i] LIKE '<%' THEN texts[i] ELSE regexp_replace(texts[i], '(https?://[^\s<>"'']+)', '<a href="\1">\1</a>', 'g') END || coalesce(tags[i], '')), '') AS out FROM x)
SELECT page_id, md5(out) AS hash, ((length(out) - length(replace(out, '<a href="http', ''))) / 13 - (length(html) - length(replace(html, '<a href="http', ''))) / 13)::BIGINT AS links FROM y""")
def p39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages: URLs in texts become links, those in attributes stay."""
    n = lambda c: (F.length(c) - F.length(F.replace(c, F.lit('<a href="http'), F.lit("")))) / 13
    d = _pages(spark, sf_dir).withColumn("out", op.linkify(F.col("html")))
    return d.select("page_id", F.md5(F.col("out").cast("binary")).alias("hash"), (n(F.col("out")) - n(F.col("html"))).cast("long").alias("links"))


@query("p39_references", f"""WITH {_PAGE_SQL}, x AS (SELECT page_id, html, strpos(html, '<h2 id="r">') AS a FROM pages_), y AS (SELECT *, a + strpos(substr(html, a + 1), '<h2>') AS z FROM x)
SELECT page_id, md5(replace(substr(html, 1, a - 1) || '<section class="refs">' || substr(html, a, z - a) || '</section>' || substr(html, z), '</body>', '<div style=''{op.FOOTER_STYLE}''>评审类型：' || CASE page_id % 4 WHEN 0 THEN '{op.NOT_TOLD}' WHEN 1 THEN '{op.REVIEW_KINDS["ai-internal"]}' WHEN 2 THEN '{op.REVIEW_KINDS["human-expert"]}' ELSE 'panel' END
  || '<br/>{op.BOUNDARY}</div></body>')) AS hash FROM y""")
def p39_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 4 == 1, "ai-internal").when(F.col("page_id") % 4 == 2, "human-expert").when(F.col("page_id") % 4 == 3, "panel")
    return _pages(spark, sf_dir).select("page_id", F.md5(op.review_footer(op.wrap_references(F.col("html")), kind).cast("binary")).alias("hash"))


@query("p39_superscripts", r"""WITH x AS (SELECT l_orderkey AS doc_id, string_agg('claim[' || l_linenumber || '], [' || l_linenumber || ',' || l_partkey % 100 || '] and [a](b) 数据[' || l_partkey || '].', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS body FROM lineitem GROUP BY l_orderkey)
SELECT doc_id, md5(regexp_replace(regexp_replace(body, '(, |数据)\[(\d{1,3}(,\d{1,3})*)\]', '\1<sup>[\2]</sup>', 'g'), '$', '') || chr(10) || '## 8. 参考文献' || chr(10) || '数据[7]') AS hash FROM x""")
def p39_superscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark at a Latin letter is none, one of more than three digits neither, nor any within the references."""
    n, p = F.col("l_linenumber").cast("string"), F.col("l_partkey")
    said = F.concat(F.lit("claim["), n, F.lit("], ["), n, F.lit(","), (p % 100).cast("string"), F.lit("] and [a](b) 数据["), p.cast("string"), F.lit("]."))
    lists = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", said.alias("t")))).alias("r"))
    text = F.concat(F.array_join(F.transform("r", lambda x: x["t"]), "\n"), F.lit("\n## 8. 参考文献\n数据[7]"))
    return lists.select("doc_id", F.md5(op.superscript_citations(text).cast("binary")).alias("hash"))
