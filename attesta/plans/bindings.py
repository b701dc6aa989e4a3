"""The claim-evidence model over the driver's tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import contracts as k
from attesta.functions.evidence import lookup, relation_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LEVEL_BY_FLAGS = {"AF": "direct", "AO": "strong_inference", "NF": "weak_inference", "NO": "context_only", "RF": "contradictory", "RO": "unsupported"}


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("claim_key"),
        F.concat(F.lit("C-"), F.col("o_orderkey").cast("string")).alias("claim_id"),
        F.concat(F.lit("R"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).cast("string")).alias("risk"),
        F.substring(F.lit("".join(k.CLAIM_CLASSES)), (F.col("o_custkey") % 8 + 1).cast("int"), F.lit(1)).alias("claim_class"),
        F.when(F.col("o_orderstatus") == "F", "live").otherwise("static").alias("verification_mode"),
        (F.col("o_orderkey") % 3 != 0).alias("covered"),
        F.col("o_custkey").alias("case_key"),
        F.col("o_orderdate").alias("found_on"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus; every thirteenth source is missing, as sources of a real corpus are."""
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") % 13 != 0)
    return p.select(
        F.col("p_partkey").alias("source_key"),
        F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("source_id"),
        lookup(F.col("p_partkey") % 9, dict(enumerate(k.AUTHORITIES)), "").alias("authority"),
        lookup(F.col("p_size") % 5, dict(enumerate(k.FRESHNESS)), "").alias("freshness"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"), F.col("p_type").alias("type"), F.col("p_size").alias("size"),
        F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit("https://host"), (F.col("p_partkey") % 97).cast("string"), F.lit(".org/"), F.col("p_size").cast("string"))).alias("url"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each claim and source: the last line wins, as the last value of a repeated key does.

    Every seventeenth key is that of a gap, no source's; places are pages, for fifth lines sections, or none.
    """
    last = F.max(F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")).alias("e")
    gap, key = F.col("l_partkey") % 17 == 0, F.col("l_partkey")
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_key"), F.when(gap, -key).otherwise(key).alias("source_key"), F.concat(F.when(gap, "G").otherwise("S"), key.cast("string")).alias("source_id")).agg(last)
    level = lookup(F.concat("e.l_returnflag", "e.l_linestatus"), LEVEL_BY_FLAGS, None)
    section = F.when(F.col("e.l_linenumber") == 5, F.concat(F.lit("sec. "), F.col("e.l_quantity").cast("int").cast("string")))
    edges = edges.select("claim_key", "source_key", "source_id", section.alias("section"), level.alias("support_level"), F.when(F.col("e.l_linenumber") % 2 == 0, F.col("e.l_quantity").cast("int")).alias("page"), F.col("e.l_linenumber").alias("line"))
    return edges.withColumn("relation", relation_of(F.col("support_level")))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of each claim with edges: a body that cites every source, references to most of them and to one more, an appendix of gaps."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").cast("string").alias("p"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("s"))
    one = e.groupBy("doc_id", "s", "p").agg(F.count("*").alias("times"), F.min("n").alias("n"))
    marks = F.repeat(F.concat(F.lit("[S"), F.col("p"), F.lit("] ")), F.col("times").cast("int"))
    body = F.concat(F.lit("Item "), F.col("p"), F.lit(" holds "), marks, F.when(F.col("s") % 10 == 0, F.concat(F.lit("[G"), F.col("n").cast("string"), F.lit("] "))).otherwise(""), F.lit("[假设] here."))
    entry = F.when(F.col("s") % 7 != 0, F.concat(F.lit("[S"), F.col("p"), F.lit("] Title "), F.col("p"), F.when(F.col("s") % 11 != 0, F.concat(F.lit(". https://x.org/"), (F.col("s") % 50).cast("string"))).otherwise("."), F.lit("\n")))
    gap = F.when(F.col("s") % 20 == 0, F.concat(F.lit("| [G"), F.col("n").cast("string"), F.lit("] | gap of "), F.col("p"), F.lit(" |\n")))
    parts = one.groupBy("doc_id").agg(*[F.sort_array(F.collect_list(F.struct("s", x.alias("t")))).alias(a) for x, a in ((body, "b"), (entry, "r"), (gap, "g"))])
    text = lambda a: F.array_join(F.transform(a, lambda x: F.coalesce(x["t"], F.lit(""))), "\n" if a == "b" else "")
    extra = F.concat(F.lit("[S"), (F.col("doc_id") % 2000).cast("string"), F.lit("] Extra. https://x.org/extra\n"))
    out = F.concat(F.lit("# Draft "), F.col("doc_id").cast("string"), F.lit("\n\n"), text("b"), F.lit("\n\n## 参考文献\n"), text("r"), extra, F.lit("\n## 附录A 缺口\n"), text("g"))
    return parts.select("doc_id", out.alias("text"))


CLAIMS_SQL = """claims AS (
  SELECT o_orderkey AS claim_key, 'C-' || o_orderkey AS claim_id, 'R' || (5 - substr(o_orderpriority, 1, 1)::INT) AS risk,
    substr('EMNLDCUJ', (o_custkey % 8 + 1)::INT, 1) AS claim_class, CASE WHEN o_orderstatus = 'F' THEN 'live' ELSE 'static' END AS verification_mode,
    o_orderkey % 3 <> 0 AS covered, o_custkey AS case_key, o_orderdate AS found_on
  FROM orders)"""
SOURCES_SQL = """sources AS (
  SELECT p_partkey AS source_key, 'S' || p_partkey AS source_id, list_extract(['A1','A2','A3','B1','B2','C1','C2','D1','D2'], (p_partkey % 9 + 1)::INT) AS authority,
    list_extract(['current','recent','historical','superseded','unknown'], (p_size % 5 + 1)::INT) AS freshness, p_name AS title, p_brand AS publisher, p_type AS type, p_size AS size,
    CASE WHEN p_partkey % 11 <> 0 THEN 'https://host' || (p_partkey % 97) || '.org/' || p_size END AS url
  FROM part WHERE p_partkey % 13 <> 0)"""
EVIDENCE_SQL = """evidence AS (
  SELECT l_orderkey AS claim_key, CASE WHEN l_partkey % 17 = 0 THEN -l_partkey ELSE l_partkey END AS source_key, CASE WHEN l_partkey % 17 = 0 THEN 'G' ELSE 'S' END || l_partkey AS source_id, l_linenumber AS line,
    CASE WHEN l_linenumber = 5 THEN 'sec. ' || l_quantity::INT END AS section, l_linenumber = 5 OR (l_linenumber % 2 = 0 AND l_quantity::INT <> 0) AS located,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'direct' WHEN 'AO' THEN 'strong_inference' WHEN 'NF' THEN 'weak_inference' WHEN 'NO' THEN 'context_only' WHEN 'RF' THEN 'contradictory' ELSE 'unsupported' END AS support_level,
    CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'context_only' WHEN 'RF' THEN 'contradicts' ELSE 'supports' END AS relation,
    CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::INT END AS page
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_returnflag DESC, l_linestatus DESC) = 1)"""
GRAPH_SQL = f"{CLAIMS_SQL}, {SOURCES_SQL}, {EVIDENCE_SQL}"
DRAFTS_SQL = """one AS (
  SELECT l_orderkey AS doc_id, l_partkey AS s, count(*) AS times, min(l_linenumber) AS n FROM lineitem GROUP BY ALL
), drafts AS (
  SELECT doc_id, '# Draft ' || doc_id || chr(10) || chr(10)
    || string_agg('Item ' || s || ' holds ' || repeat('[S' || s || '] ', times) || CASE WHEN s % 10 = 0 THEN '[G' || n || '] ' ELSE '' END || '[假设] here.', chr(10) ORDER BY s)
    || chr(10) || chr(10) || '## 参考文献' || chr(10)
    || string_agg(CASE WHEN s % 7 <> 0 THEN '[S' || s || '] Title ' || s || CASE WHEN s % 11 <> 0 THEN '. https://x.org/' || (s % 50) ELSE '.' END || chr(10) ELSE '' END, '' ORDER BY s)
    || '[S' || (doc_id % 2000) || '] Extra. https://x.org/extra' || chr(10) || chr(10) || '## 附录A 缺口' || chr(10)
    || string_agg(CASE WHEN s % 20 = 0 THEN '| [G' || n || '] | gap of ' || s || ' |' || chr(10) ELSE '' END, '' ORDER BY s) AS text
  FROM one GROUP BY doc_id)"""
