"""Queries over texts: hashes, names, chapters, scorecard, references, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as t
from attesta.functions.evidence import coverage, lookup
from attesta.operators import documents as doc_op
from attesta.operators import ingest as ingest_op
from attesta.operators import references as ref_op
from attesta.plans import bindings as b
from attesta.plans.registry import query

_WS = "[\\s\\x{00a0}\\x{3000}]"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents")


@query("a13_nsp_chars", f"SELECT doc_id, length(regexp_replace(text, '{_WS}', '', 'g'))::INT AS chars FROM documents")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.dense_length(F.col("text")).alias("chars"))


@query("p29_quote_hash", f"SELECT doc_id, 'sha256:' || sha256(trim(regexp_replace(text, '{_WS}+', ' ', 'g'))) AS hash FROM documents")
def p29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.quote_hash(F.col("text")).alias("hash"))


@query("p30_fullwidth", "SELECT p_partkey, p_name || ' ' || p_brand AS half FROM part")
def p30(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = "".join(chr(x) for x in range(0x21, 0x7F)) + " "
    wide = "".join(chr(x + 0xFEE0) for x in range(0x21, 0x7F)) + "　"
    d = b.table(spark, sf_dir, "part").withColumn("full", F.translate(F.concat_ws(" ", "p_name", "p_brand"), plain, wide))
    return d.select("p_partkey", t.to_half_width(F.col("full")).alias("half"))


@query("p27_filename", r"""SELECT p_partkey, 'S' || p_partkey || '_' || trim(regexp_replace(replace(trim(regexp_replace(regexp_replace(p_name || ': a/b*? "x" <' || p_brand || '> .', '[\\/:*?"<>|]+', ' ', 'g'), '\s+', ' ', 'g')), ' ', '_'), '_+', '_', 'g'), '._') || '.pdf' AS name FROM part""")
def p27(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part")
    title = F.concat(F.col("p_name"), F.lit(': a/b*? "x" <'), F.col("p_brand"), F.lit("> ."))
    return p.select("p_partkey", t.file_name(F.concat(F.lit("S"), F.col("p_partkey").cast("string")), title).alias("name"))


@query("p40_truncated", "SELECT doc_id, substr(trim(text), 1, 80) AS short, substr(trim(text), 1, 60) AS shorter FROM documents")
def p40(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.trim("text")
    return _docs(spark, sf_dir).select("doc_id", F.substring(x, 1, 80).alias("short"), F.substring(x, 1, 60).alias("shorter"))


@query("j15_md5_anti", "WITH f AS (SELECT doc_id AS path, md5(text) AS md5 FROM documents) SELECT path, md5 FROM f WHERE md5 NOT IN (SELECT md5 FROM f WHERE path % 10 = 0) QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY path) = 1")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6, SC17 too."""
    f = _docs(spark, sf_dir).select(F.col("doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("md5"))
    return ingest_op.new_files(f, f.where("path % 10 = 0")).select("path", "md5")


@query("w5_section_carry", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), m AS (SELECT doc_id, pos, last_value(CASE WHEN length(line) % 7 = 0 THEN length(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS label FROM l) SELECT doc_id, pos::INT AS pos, label::INT AS label FROM m")
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("line")
    return doc_op.carried(doc_op.lines_of(_docs(spark, sf_dir).select("doc_id", "text")), F.when(n % 7 == 0, n)).select("doc_id", "pos", "label")


@query("w4_next_line", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) SELECT doc_id, pos::INT AS pos, length(lead(line) OVER (PARTITION BY doc_id ORDER BY pos))::INT AS next FROM l")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = doc_op.lines_of(_docs(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "pos", F.length(F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos"))).alias("next"))


@query("w6_entry_merge", "SELECT l_orderkey AS doc_id, count(*)::INT AS entries, sum(l_linenumber % 3)::BIGINT AS continued FROM lineitem GROUP BY l_orderkey")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 too: an entry for each line item, with up to two lines that go on with it."""
    l = b.table(spark, sf_dir, "lineitem")
    more = F.repeat(F.lit("    continued here\n"), (F.col("l_linenumber") % 3).cast("int"))
    entry = F.concat(F.lit("["), F.col("l_linenumber").cast("string"), F.lit("] Title. Year.\n"), more)
    d = l.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("refs"))
    d = d.withColumn("entries", doc_op.entries(F.col("refs")))
    return d.select("doc_id", F.size("entries").alias("entries"), F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + t.count(e, " continued here")).alias("continued"))


def _chaptered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: an exempt chapter, then one for each line with the elements that its numbers choose."""
    l = b.table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    some = lambda when, words: F.when(when, words).otherwise("")
    body = F.concat(F.lit("## "), n.cast("string"), F.lit(". 章 "), F.col("l_partkey").cast("string"), F.lit("\n"), some(F.col("l_partkey") % 2 == 0, "### 总体目标\n"), some(F.col("l_partkey") % 3 == 0, "采用模型\n"), some(F.col("l_partkey") % 5 != 0, "实施步骤\n"), some(F.col("l_partkey") % 7 != 0, "依据导则\n"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")), F.lit("\n"))
    d = l.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(n, "l_partkey", "l_quantity", body.alias("b")))).alias("bs"))
    return d.select("doc_id", F.concat(F.lit("# T\n## 第一章 绪论\n略\n"), F.array_join(F.transform("bs", lambda x: x["b"]), "")).alias("text"))


@query("g5_framework_depth", """WITH x AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)::INT AS chapter, '章 ' || l_partkey AS title, l_partkey AS p,
  (2 + length(l_linenumber::VARCHAR) + 1 + 1 + length(l_partkey::VARCHAR) + CASE WHEN l_partkey % 2 = 0 THEN 7 ELSE 0 END + CASE WHEN l_partkey % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN l_partkey % 5 <> 0 THEN 4 ELSE 0 END + CASE WHEN l_partkey % 7 <> 0 THEN 4 ELSE 0 END + l_quantity::INT)::INT AS chars FROM lineitem),
y AS (SELECT *, concat_ws(',', CASE WHEN p % 2 <> 0 THEN '目标' END, CASE WHEN p % 3 <> 0 THEN '方法' END, CASE WHEN p % 5 = 0 THEN '输入输出' END, CASE WHEN p % 7 = 0 THEN '标准依据' END) AS missing FROM x)
SELECT doc_id, chapter, title, chars, missing, chars < 40 AS thin, missing = '' AND chars >= 40 AS passed FROM y""")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, F22, F23 too."""
    d = doc_op.framework_depth(_chaptered(spark, sf_dir), min_chars=40)
    return d.select("doc_id", "chapter", "title", "chars", F.array_join("missing", ",").alias("missing"), "thin", "passed")


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as journal papers whose abstract, keywords, chapters, references and length follow from their numbers.

    Rows are short and papers are long: the rows are dealt out first.
    """
    p = b.table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism)
    key, size = F.col("p_partkey"), F.col("p_size").cast("int")
    nl = F.lit("\n")
    refs = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(key % 15, F.lit(1)).cast("int")), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("] 作者. 题名"), F.when((key + i) % 4 == 0, "").otherwise("[J]"), F.lit(". 刊名, 2020.\n    Author A. An English title of the paper that is long enough[J]. Journal, 2020."))), "\n")
    conclusion = F.array_join(F.transform(F.sequence(F.lit(1), (key % 4 + 1).cast("int")), lambda i: F.concat(F.lit("（"), i.cast("string"), F.lit("）成立。"))), "")
    text = F.concat(
        F.lit("# 题目\n中图分类号：TM7 "), F.when(key % 2 == 0, "文献标志码：A").otherwise(""), nl,
        F.lit("摘要：针对问题提出方法，误差下降 5%，结果表明有效"), F.repeat(F.lit("字"), size * 10), nl, F.lit("关键词："), F.array_join(F.array_repeat(F.lit("词语"), (key % 9 + 1).cast("int")), "；"), nl,
        F.lit("Abstract: This is the English abstract of the paper\nKey words: one; two\n"),
        F.when(key % 3 == 0, "## 引言\n").otherwise("## 0 引言\n"), F.repeat(F.lit("正文"), size * 80), F.lit("\n## 1 方法\n见图 1 与表 1。\n"), F.when(key % 5 == 0, "我们认为。\n").otherwise(""), F.lit("图 1 流程\nFig. 1 Flow\n## "), F.when(key % 7 == 0, "3").otherwise("2"), F.lit(" "), F.when(key % 11 == 0, "讨论").otherwise("结论"), nl, conclusion, nl,
        F.lit("参考文献\n"), refs,
    )
    return p.select(key.alias("doc_id"), text.alias("text"))


_PAPER = """x AS (SELECT p_partkey AS k, p_size AS s, greatest(p_partkey % 15, 1) AS r FROM part),
y AS (SELECT *, 18 + s * 10 AS n, (SELECT count(*) FROM range(1, r + 1) t(i) WHERE (k + i) % 4 <> 0) AS tagged FROM x), z AS (SELECT k AS doc_id,
  CASE WHEN n BETWEEN 150 AND 350 THEN 2 WHEN n BETWEEN 100 AND 450 THEN 1 ELSE 0 END AS S1, 2 AS S2, CASE WHEN k % 9 + 1 BETWEEN 5 AND 6 THEN 2 WHEN k % 9 + 1 BETWEEN 3 AND 8 THEN 1 ELSE 0 END AS S3, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS S4,
  1 AS S5, CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS S6, CASE WHEN k % 7 = 0 THEN 1 ELSE 2 END AS S7, CASE WHEN k % 11 = 0 THEN 0 ELSE 2 END AS S8, CASE WHEN k % 11 = 0 THEN 0 WHEN k % 4 + 1 >= 3 THEN 2 ELSE 1 END AS S9,
  CASE WHEN r >= 10 THEN 2 WHEN r >= 7 THEN 1 ELSE 0 END AS S10, 2 AS S11, 2 AS S12, 2 AS S13, 2 AS S14, CASE WHEN k % 11 = 0 THEN 1 ELSE 2 END AS S15, CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END AS S16,
  CASE WHEN chars >= 6000 THEN 2 WHEN chars >= 3600 THEN 1 ELSE 0 END AS S17
  FROM (SELECT *, CASE WHEN k % 3 = 0 THEN 4 ELSE 5 END + s * 160 + 5 + 8 + CASE WHEN k % 5 = 0 THEN 5 ELSE 0 END + 4 + 9 + 2 + 1 + 2 + (k % 4 + 1) * 6 AS chars FROM y))"""


@query("g6_scorecard", f"""WITH {_PAPER}, t AS (SELECT *, S1+S2+S3+S4+S5+S6+S7+S8+S9+S10+S11+S12+S13+S14+S15+S16+S17 AS total FROM z)
SELECT *, total / 34.0 >= 0.85 AND S1 > 0 AND S3 > 0 AND S6 > 0 AND S8 > 0 AND S10 > 0 AND S11 > 0 AND S17 > 0 AS passed FROM t""")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, P3, P9, F29, J16 too."""
    return doc_op.scorecard(_papers(spark, sf_dir)).select("doc_id", *[f"S{i}" for i in range(1, 18)], "total", "passed")


_TYPES = ["journal_paper", "china_standard", "epri_web", "report"]


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    when = lambda m, v: F.when(key % m != 0, v)
    return p.select(
        (key % 10).alias("case_id"), key.alias("pos"), F.concat(F.when(key % 3 == 0, "S").otherwise(""), key.cast("string")).alias("source_id"), F.col("p_name").alias("title"), F.lit("x").alias("title_or_name"), when(5, F.col("p_brand")).alias("publisher"), when(4, F.concat(F.lit("20"), (key % 90 + 10).cast("string"))).alias("year"),
        when(7, F.concat(F.lit("https://x.org/"), key.cast("string"))).alias("url"), lookup(key % 4, dict(enumerate(_TYPES)), "").alias("type"), when(6, F.lit("J, 2020, 3(1): 5")).alias("series"), when(8, F.lit("Li")).alias("authors"),
        when(9, F.lit("Beijing")).alias("city"), when(2, F.lit("English title")).alias("title_en"), when(11, F.lit("Li Y")).alias("authors_en"), F.lit("").alias("series_en"), F.lit("J Eng").alias("journal_en"), F.lit("3").alias("volume"), F.lit(None).cast("string").alias("issue"), F.lit("9").alias("page"),
    )


_CITED = """c AS (SELECT p_partkey % 10 AS case_id, p_partkey AS pos, 'S' || p_partkey AS tag, p_name AS title, CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE '' END AS publisher, CASE WHEN p_partkey % 4 <> 0 THEN '20' || (p_partkey % 90 + 10) ELSE '' END AS year,
  CASE WHEN p_partkey % 7 <> 0 THEN 'https://x.org/' || p_partkey ELSE '' END AS url, p_partkey % 4 AS kind, CASE WHEN p_partkey % 6 <> 0 THEN 'J, 2020, 3(1): 5' ELSE '' END AS series, CASE WHEN p_partkey % 8 <> 0 THEN 'Li' ELSE '' END AS authors, CASE WHEN p_partkey % 9 <> 0 THEN 'Beijing' ELSE '' END AS city,
  CASE WHEN p_partkey % 2 <> 0 THEN CASE WHEN p_partkey % 11 <> 0 THEN 'Li Y. ' ELSE '' END || 'English title[J].' || CASE WHEN p_partkey % 4 <> 0 THEN ' J Eng, 20' || (p_partkey % 90 + 10) || ', 3(?): 9.' ELSE '' END ELSE '' END AS english FROM part)"""
_PLAIN = "'[' || tag || '] ' || title || '.' || CASE WHEN publisher <> '' THEN ' ' || publisher || CASE WHEN year <> '' THEN ', ' || year ELSE '' END || '.' WHEN year <> '' THEN ' ' || year || '.' ELSE '' END || CASE WHEN url <> '' THEN ' URL: ' || url ELSE ' (URL unavailable)' END"
_TYPED = """CASE kind WHEN 0 THEN CASE WHEN authors <> '' THEN authors || '. ' ELSE '' END || title || CASE WHEN series <> '' THEN '[J]. ' || series || '.' ELSE '[J].' END || CASE WHEN english <> '' THEN chr(10) || '    ' || english ELSE '' END
  WHEN 1 THEN CASE WHEN series <> '' THEN series || '. ' ELSE '' END || title || '[S].'
  WHEN 2 THEN CASE WHEN publisher <> '' THEN publisher || '. ' ELSE '' END || title || '[EB/OL].' || CASE WHEN year <> '' THEN ' ' || year || '[引用日期见正文].' ELSE '' END || CASE WHEN url <> '' THEN ' ' || url || '.' ELSE '' END
  ELSE CASE WHEN publisher <> '' THEN publisher || '. ' ELSE '' END || title || '[R]. ' || CASE WHEN series <> '' THEN series || '. ' ELSE '' END || CASE WHEN publisher <> '' THEN CASE WHEN city <> '' THEN city || ': ' ELSE '' END || publisher || CASE WHEN year <> '' THEN ', ' || year ELSE '' END || '.' WHEN year <> '' THEN year || '.' ELSE '' END || CASE WHEN url <> '' THEN ' ' || url || '.' ELSE '' END END"""


@query("p22_reference_entry", f"WITH {_CITED} SELECT pos, {_PLAIN} AS entry FROM c")
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).select("pos", ref_op.plain_entry().alias("entry"))


@query("p23_gbt_entry", f"WITH {_CITED} SELECT pos, {_TYPED} AS entry FROM c")
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P24 too."""
    return _cited(spark, sf_dir).select("pos", ref_op.typed_entry().alias("entry"))


@query("p24_bilingual_line", f"WITH {_CITED} SELECT pos, english FROM c")
def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).select("pos", ref_op.bilingual_line().alias("english"))


@query("p25_section", f"WITH {_CITED} SELECT case_id, '## 参考文献' || chr(10) || chr(10) || string_agg({_PLAIN}, chr(10) || chr(10) ORDER BY pos) || chr(10) AS section FROM c GROUP BY case_id")
def p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ref_op.section(_cited(spark, sf_dir))


@query("sk7_splice", f"""WITH {_CITED}, s AS (SELECT case_id, string_agg({_PLAIN}, chr(10) || chr(10) ORDER BY pos) AS entries FROM c GROUP BY case_id)
SELECT case_id, CASE case_id % 3 WHEN 0 THEN '# T' || chr(10) || '## 13. 参考文献' || chr(10) || chr(10) || entries || chr(10) || '## 附录A' || chr(10) || 'x' WHEN 1 THEN '# T' || chr(10) || '## 参考文献' || chr(10) || chr(10) || entries || chr(10) || chr(10) || '## 附录A' || chr(10) || 'x'
  ELSE '# T' || chr(10) || chr(10) || '## 参考文献' || chr(10) || chr(10) || entries || chr(10) END AS text FROM s""")
def sk7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ref_op.section(_cited(spark, sf_dir))
    draft = lookup(F.col("case_id") % 3, {0: "# T\n## 13. 参考文献\n[S1] old\n## 附录A\nx", 1: "# T\n## 附录A\nx"}, "# T\n")
    return d.withColumn("draft", draft).select("case_id", ref_op.spliced(F.col("draft"), F.col("section")).alias("text"))


@query("f18_coverage", "SELECT p_partkey, p_partkey % 8 NOT IN (0, 5, 7) AS covered FROM part")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 8
    none = F.array().cast("array<string>")
    against = F.when(k == 1, F.array(F.lit("x"))).otherwise(none)
    search = F.when(k == 2, '["q"]').when(k == 3, '{"q": 1}').when(k == 4, "本次检索未找到公开反证").when(k == 5, "[]").otherwise("")
    why = F.when(k == 6, "未发现").when(k == 7, "ok").otherwise("")
    return p.select("p_partkey", coverage(against, none, [search], F.lit(None).cast("string"), why).alias("covered"))


@query("l5_trigger_words", """SELECT conv_id * 1000 + turn AS doc_id, 0 AS pos, list_extract(['critical', 'high', 'medium'], (turn % 4 + 1)::INT) AS severity, list_extract(['颠覆性', '显著提升', '有效促进'], (turn % 4 + 1)::INT) AS word,
  conv_id % 2 = 0 AS cited, turn % 4 = 0 AND conv_id % 2 <> 0 AS blocks FROM conversations WHERE turn % 4 < 3""")
def l5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.table(spark, sf_dir, "conversations")
    word = lookup(F.col("turn") % 4, {0: "颠覆性", 1: "显著提升", 2: "有效促进"}, "普通")
    s = F.concat(F.lit("成果"), word, F.when(F.col("conv_id") % 2 == 0, "[S1]").otherwise(""), F.lit("。"))
    return doc_op.triggers(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lit(0).alias("pos"), s.alias("sentence")))


@query("l20_template_phrases", """SELECT p_partkey AS doc_id, 0 AS pos, CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 7 WHEN 3 THEN 6 ELSE 3 END AS phrase
  FROM part WHERE p_partkey % 6 <> 5 AND NOT (p_partkey % 6 IN (1, 2) AND p_partkey % 4 = 1)""")
def l20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A citation excuses two of the phrases."""
    key = F.col("p_partkey")
    s = lookup(key % 6, {0: "本研究拓展了传感的理论边界", 1: "填补了该领域的空白", 2: "在前人基础上改进", 3: "对产业具有深远影响", 4: "可为设计提供参考"}, "普通句子")
    p = b.table(spark, sf_dir, "part").select(key.alias("doc_id"), F.lit(0).alias("pos"), F.concat(s, F.when(key % 4 == 1, "[S3]").otherwise(""), F.lit("。")).alias("sentence"))
    return doc_op.template_phrases(p)


_REQUESTS = ["国防科技报告", "某项目实施方案", "期刊论文投稿", "专利交底书", "发明专利权利要求书", "技术白皮书", "现状综述", "可行性论证", "立项申报", "博士学位论文（理论）", "硕士论文 实验", "本科毕业论文", "学位论文", "其它"]
_TEMPLATES = ["report_gf", "plan_implementation", "paper_journal", "patent_disclosure", "patent_application", "whitepaper", "report_survey", "report_feasibility", "proposal", "thesis_phd", "thesis_ms", "thesis_ug", "thesis_ug", "proposal"]


@query("l17_doc_type", f"SELECT p_partkey, list_extract({_TEMPLATES!r}, (p_partkey % 14 + 1)::INT) AS doc_type, CASE WHEN p_partkey % 14 = 9 THEN '理论' WHEN p_partkey % 14 = 10 THEN '实证' WHEN p_partkey % 14 IN (11, 12) THEN '混合' END AS research FROM part")
def l17(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part").withColumn("request", lookup(F.col("p_partkey") % 14, dict(enumerate(_REQUESTS)), ""))
    return p.select("p_partkey", doc_op.document_type(F.col("request")).alias("doc_type"), doc_op.research_type(F.col("request")).alias("research"))


_TOPICS = ["深度学习算法", "小学课程教学", "核电缆老化", "固态电池材料", "预算与投资", "患者用药", "产业政策", "健康教育课程", "山水诗", "大模型与设备安全及市场"]
_EXPERTS = ["ai,education", "education", "engineering", "engineering", "social_science", "medical", "social_science", "education,medical", "education,engineering", "ai,engineering"]


@query("l18_expert_roles", f"SELECT p_partkey, list_extract({_EXPERTS!r}, (p_partkey % 10 + 1)::INT) AS roles FROM part")
def l18(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = lookup(F.col("p_partkey") % 10, dict(enumerate(_TOPICS)), "")
    return b.table(spark, sf_dir, "part").select("p_partkey", F.array_join(doc_op.experts(topic), ",").alias("roles"))


@query("l21_responses", """SELECT o_custkey AS review, o_orderkey AS comment, CASE WHEN o_orderkey % 3 = 0 THEN 'no response' WHEN o_orderkey % 3 = 1 THEN 'unknown disposition' ELSE 'blocker not cleared' END AS problem FROM orders
  WHERE o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 10 = 0) OR (o_orderkey % 3 = 2 AND o_orderstatus = 'F')""")
def l21(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.operators import brief

    o, n = b.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    key = [F.col("o_custkey").alias("review"), n.alias("comment")]
    comments = o.select(*key, F.when(F.col("o_orderstatus") == "F", "阻断").otherwise("建议").alias("severity"))
    kind = F.when(n % 3 == 2, "保留原表述并说明理由").when(n % 10 == 0, "later").otherwise("已修改")
    return brief.response_problems(comments, o.where(n % 3 != 0).select(*key, kind.alias("disposition")))


@query("l19_final_choice", "SELECT o_orderkey, coalesce(r.p, -o_orderkey) AS chosen FROM orders LEFT JOIN (SELECT l_orderkey, max(l_partkey) AS p FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) r ON l_orderkey = o_orderkey")
def l19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expert's revision if there is one, else the draft."""
    r = b.table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.max("l_partkey").alias("p"))
    o = b.table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(r, o["o_orderkey"] == r["l_orderkey"], "left").select("o_orderkey", F.coalesce("p", -F.col("o_orderkey")).alias("chosen"))


@query("a17_metadata_confidence", "SELECT p_partkey, CASE WHEN (p_partkey % 2 <> 0)::INT + (p_partkey % 3 <> 0)::INT + (p_partkey % 5 <> 0)::INT + (p_partkey % 7 <> 0)::INT + 1 >= 4 AND p_partkey % 2 <> 0 THEN 'high' WHEN (p_partkey % 2 <> 0)::INT + (p_partkey % 3 <> 0)::INT + (p_partkey % 5 <> 0)::INT + (p_partkey % 7 <> 0)::INT + 1 >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM part")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    some = lambda m: F.when(key % m != 0, "x").otherwise("")
    d = b.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), some(2).alias("authors"), some(3).alias("journal"), some(5).alias("year"), some(7).alias("volume"))
    return d.select("p_partkey", ingest_op.metadata_confidence().alias("confidence"))


@query("p31_bibliography", """WITH x AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT k AS p_partkey, CASE WHEN k % 4 = 0 THEN '10.1234/a.' || k ELSE '' END AS doi, CASE k % 3 WHEN 0 THEN '电工学报' WHEN 1 THEN 'Journal of Cables' ELSE '' END AS journal, CASE WHEN k % 5 = 0 THEN '100-102' ELSE '' END AS page,
  CASE k % 3 WHEN 2 THEN '' ELSE (k % 50)::VARCHAR END AS volume, CASE k % 3 WHEN 2 THEN CASE WHEN k % 5 = 0 THEN '7' ELSE '' END ELSE (s % 12 + 1)::VARCHAR END AS issue,
  CASE WHEN k % 5 = 0 THEN '2011' WHEN k % 3 = 2 THEN '' ELSE '20' || (k % 90 + 10) END AS year, CASE WHEN k % 3 = 0 THEN 'zh' ELSE 'en' END AS lang FROM x""")
def p31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of pages with a Chinese header, an English one or none; what stands after forty lines is another paper's."""
    p = b.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    said = lambda x: x.cast("string")
    chinese = F.concat(F.lit("第 "), said(key % 50), F.lit(" 卷 第 "), said(F.col("p_size") % 12 + 1), F.lit(" 期\n电工学报\n20"), said(key % 90 + 10), F.lit(" 年\n"))
    english = F.concat(F.lit("Journal of Cables Vol. "), said(key % 50), F.lit(" No. "), said(F.col("p_size") % 12 + 1), F.lit(" March 20"), said(key % 90 + 10), F.lit("\n"))
    head = F.concat(F.when(key % 3 == 0, chinese).when(key % 3 == 1, english).otherwise("plain\n"), F.when(key % 5 == 0, "文章编号：1000-2011(07)-00100-3\n").otherwise(""), F.when(key % 4 == 0, F.concat(F.lit("ＤＯＩ：10.1234/a."), said(key), F.lit(".\n"))).otherwise("10.9999/no.name\n"))
    text = F.concat(head, F.repeat(F.lit("x\n\n"), F.lit(40)), F.lit("DOI:10.9999/other.1\n别的学报 2015，3(4)\n2016 年\n"))
    return p.select("p_partkey", *[c.alias(n) for n, c in ingest_op.bibliography(text).items()])


@query("p38_quote", "SELECT p_partkey, CASE WHEN p_size < 30 THEN '' ELSE 'A ' || p_name || repeat(' word', p_size::INT) || '.' END AS quote FROM part")
def p38(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 too."""
    p = b.table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("int"))
    s = F.concat(F.lit("Short one. A "), F.col("p_name"), F.when(F.col("p_size") < 30, "").otherwise(F.repeat(F.lit(" word"), F.col("p_size"))), F.lit(". Other end!"))
    return p.select("p_partkey", ingest_op.quote(s, ingest_op.keywords(F.col("p_name"))).alias("quote"))


@query("p26_diagrams", "SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey % 2 = 0 AS wide FROM lineitem")
def p26(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = b.table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_partkey") % 2 == 0, "一个非常长的节点标签超过十四个汉字").otherwise("short")
    text = F.concat(F.lit("x\n```mermaid\nA["), label, F.lit("] --> B[end]\n```\n"))
    d = ingest_op.diagrams(l.select(F.col("l_orderkey").alias("doc_id"), text.alias("text"), F.col("l_linenumber").alias("n")).withColumn("doc_id", F.struct("doc_id", "n")))
    return d.select("doc_id.doc_id", "doc_id.n", (F.size(ingest_op.wide_labels(F.col("code"))) > 0).alias("wide"))


@query("j11_title_mismatch")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the similarity is Ratcliff and Obershelp's. Tested against difflib."""
    p = b.table(spark, sf_dir, "part")
    sid = F.concat(F.lit("S"), F.col("p_partkey").cast("string"))
    sources = p.select(sid.alias("source_id"), F.col("p_name").alias("title"))
    shown = F.when(F.col("p_partkey") % 3 == 0, "an unrelated heading").otherwise(F.initcap("p_name"))
    entries = p.select((F.col("p_partkey") % 100).alias("doc_id"), sid.alias("source_id"), F.concat(F.lit("["), sid, F.lit("] "), shown, F.lit(". "), F.col("p_brand"), F.lit(". https://x.org")).alias("entry"))
    return ingest_op.title_mismatches(entries, sources)


@query("j11_undecided", "SELECT count(*) AS pairs, count(*) FILTER (p_partkey % 3 = 0) AS unlike, 0::BIGINT AS undecided FROM part WHERE p_name <> ''")
def j11_undecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of titles bounds leave to Python: those that the two readings can't be told by."""
    p = b.table(spark, sf_dir, "part")
    sid = F.concat(F.lit("S"), F.col("p_partkey").cast("string"))
    shown = F.when(F.col("p_partkey") % 3 == 0, "ÄÖÜ ÄÖÜ ÄÖÜ ÄÖÜ ÄÖÜ ÄÖÜ").otherwise(F.initcap("p_name"))
    entries = p.select((F.col("p_partkey") % 100).alias("doc_id"), sid.alias("source_id"), F.concat(F.lit("["), sid, F.lit("] "), shown, F.lit(". "), F.col("p_brand"), F.lit(". https://x.org")).alias("entry"))
    d = ingest_op.title_pairs(entries, p.select(sid.alias("source_id"), F.col("p_name").alias("title"))).select("unlike")
    return d.agg(F.count("*").alias("pairs"), F.count_if("unlike").alias("unlike"), F.count_if(F.col("unlike").isNull()).alias("undecided"))


@query("sk5_text_header", "SELECT doc_id, '[S' || doc_id || '] ' || source || chr(10) || 'URL: ' || chr(10) || 'Chars: ' || length(text) || CASE WHEN doc_id % 3 = 0 THEN ' (TRUNCATED)' ELSE '' END || chr(10) || repeat('=', 60) || chr(10) || chr(10) || text AS content FROM documents")
def sk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", ingest_op.text_with_header(F.concat(F.lit("S"), F.col("doc_id").cast("string")), F.col("source"), F.lit(None).cast("string"), F.col("text"), F.col("doc_id") % 3 == 0).alias("content"))


@query("sk5_write_back", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN true END AS extracted, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS chars, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS quote FROM part")
def sk5_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part").withColumn("source_id", F.concat(F.lit("S"), F.col("p_partkey").cast("string")))
    e = p.where("p_partkey % 2 = 0").select("source_id", F.lit("x.txt").alias("path"), F.col("p_size").alias("chars"), F.lit(False).alias("truncated"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(" ").alias("quote"))
    d = ingest_op.text_written_back(p, e)
    return d.select("p_partkey", F.col("pdf_text_extracted").alias("extracted"), F.col("pdf_text_chars").alias("chars"), F.col("verified_quote").alias("quote"))


_TITLE, _AUTHORS = "多源数据融合的电缆老化评估方法", "王小明，李大山"


@query("sc17_corpus_rows", f"""WITH f AS (SELECT p_partkey AS p, 'x' || (p_partkey - p_partkey % 2) AS md5, lpad(p_partkey::VARCHAR, 9, '0') AS name FROM part WHERE p_partkey % 5 <> 0),
firsts AS (SELECT p, name FROM f QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY name) = 1), n AS (SELECT *, row_number() OVER (ORDER BY name) + 3 AS id FROM firsts)
SELECT 'S' || id AS source_id, name AS title_or_name, CASE WHEN p % 3 = 0 THEN '{_TITLE}' ELSE name END AS title, CASE WHEN p % 3 = 0 THEN '{_AUTHORS}' ELSE '' END AS authors, CASE WHEN p % 3 = 0 THEN '仪器学报, 2021, ' || (p % 40) || '(' || (p % 9) || ')' ELSE '' END AS series,
  CASE WHEN p % 3 = 0 THEN 'high' ELSE 'low' END AS meta_confidence, CASE WHEN p % 3 = 0 THEN 'recent' ELSE 'historical' END AS freshness FROM n""")
def sc17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P31, F28, T5 too: files whose content comes twice, first pages with and without a title, ids after three that are taken."""
    key = F.col("p_partkey")
    p = b.table(spark, sf_dir, "part").where(key % 5 != 0)
    page = F.concat(F.lit("仪器学报 2021，"), (key % 40).cast("string"), F.lit("("), (key % 9).cast("string"), F.lit(")\n多源数据融合的\n电缆老化评估方法\n王小明1，李大山2\n某某大学 某学院\n摘要：本文提出一种方法。\n多源数据融合的电缆老化评估方法"))
    files = p.select(F.concat(F.lit("/in/"), F.lpad(key.cast("string"), 9, "0"), F.lit(".pdf")).alias("path"), F.concat(F.lit("x"), (key - key % 2).cast("string")).alias("md5"), F.when(key % 3 == 0, page).otherwise("。").alias("text"))
    seen = spark.createDataFrame([("none",)], "md5 string")
    taken = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "source_id string")
    out = ingest_op.corpus_rows(files, seen, taken)
    return out.select("source_id", "title_or_name", "title", "authors", "series", "meta_confidence", "freshness")


@query("p41_review_kind", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'AI internal' WHEN 1 THEN 'AI cross-model' WHEN 2 THEN 'human expert' ELSE 'other' END AS label FROM part")
def p41(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lookup(F.col("p_partkey") % 4, {0: "ai-internal", 1: "ai-cross-model", 2: "human-expert"}, "x")
    label = lookup(F.col("kind"), {"ai-internal": "AI internal", "ai-cross-model": "AI cross-model", "human-expert": "human expert"}, "other")
    return b.table(spark, sf_dir, "part").withColumn("kind", kind).select("p_partkey", label.alias("label"))


@query("p5_html_slice", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<h2 class="x">Key <b>results</b></h2><p>' || page_id || '</p>' WHEN 1 THEN '<h2>results</h2>' || chr(10) || html END AS part FROM pages""")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between two sections, at the end, and in none; the pages' own headings are of the first level."""
    page, own = F.col("page_id"), F.regexp_replace("html", r"(?s)<h2.*", "")
    html = F.when(page % 3 == 0, F.concat(F.lit("<h2>Other</h2><p>results</p><h2 class=\"x\">Key <b>results</b></h2><p>"), page.cast("string"), F.lit("</p><h2>Next</h2><p>results</p>")))
    html = html.when(page % 3 == 1, F.concat(F.lit("<h2>First</h2><h2>results</h2>\n"), F.col("html"))).otherwise(own)
    return b.table(spark, sf_dir, "pages").select("page_id", t.html_section(html, "results").alias("part"))
