"""Queries over the corpus of sources and over URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta import contracts as k
from attesta.functions import urls
from attesta.functions.evidence import filled, lookup
from attesta.operators import corpus as op
from attesta.plans import bindings as b
from attesta.plans.bindings import SOURCES_SQL
from attesta.plans.registry import query


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a corpus with all that can be wrong: repeated and blank ids, bad enumerations, suspect and missing URLs."""
    p = b.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        (key % 7).alias("case_id"), key.alias("pos"),
        F.when(key % 50 == 0, " ").when(key % 41 == 0, "S1").otherwise(F.concat(F.lit("S"), key.cast("string"))).alias("source_id"),
        F.when(key % 31 != 0, F.col("p_name")).alias("title"), F.when(key % 62 == 0, F.col("p_brand")).alias("title_or_name"),
        F.when(key % 11 == 0, F.lit(None)).when(key % 17 == 0, F.concat(F.lit("https://zh.wikipedia.org/"), key.cast("string"))).otherwise(F.concat(F.lit("https://host.org/"), (key % 900).cast("string"))).alias("url"),
        F.when(key % 6 != 0, "confirmed").alias("access_status"),
        F.when(key % 19 == 0, "E5").when(key % 23 == 0, "").otherwise(lookup(key % 9, dict(enumerate(k.AUTHORITIES)), "")).alias("authority"),
        F.when(key % 29 == 0, "new").when(key % 37 == 0, F.lit(None)).otherwise(lookup(F.col("p_size") % 5, dict(enumerate(k.FRESHNESS)), "")).alias("freshness"),
        F.when(key % 43 == 0, "hacker").when(key % 2 == 0, "registry").alias("source_origin"),
        F.when(F.col("p_type") == "PROMO", "journal_paper").otherwise(F.col("p_type")).alias("type"),
    )


_CORPUS = """corpus AS (SELECT p_partkey % 7 AS case_id, p_partkey AS pos, CASE WHEN p_partkey % 50 = 0 THEN '' WHEN p_partkey % 41 = 0 THEN 'S1' ELSE 'S' || p_partkey END AS source_id,
  coalesce(CASE WHEN p_partkey % 31 <> 0 THEN p_name END, CASE WHEN p_partkey % 62 = 0 THEN p_brand END, '') AS title,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN 'https://zh.wikipedia.org/' || p_partkey ELSE 'https://host.org/' || (p_partkey % 900) END AS url,
  CASE WHEN p_partkey % 6 <> 0 THEN 'confirmed' ELSE '' END AS access_status,
  CASE WHEN p_partkey % 19 = 0 THEN 'E5' WHEN p_partkey % 23 = 0 THEN '' ELSE list_extract(['A1','A2','A3','B1','B2','C1','C2','D1','D2'], (p_partkey % 9 + 1)::INT) END AS authority,
  CASE WHEN p_partkey % 29 = 0 THEN 'new' WHEN p_partkey % 37 = 0 THEN '' ELSE list_extract(['current','recent','historical','superseded','unknown'], (p_size % 5 + 1)::INT) END AS freshness,
  CASE WHEN p_partkey % 43 = 0 THEN 'hacker' WHEN p_partkey % 2 = 0 THEN 'registry' ELSE '' END AS source_origin, p_type FROM part)"""
_DUP_URLS = "SELECT case_id, url, string_agg(source_id, ',' ORDER BY source_id) AS ids FROM corpus WHERE url <> '' AND source_id <> '' GROUP BY ALL HAVING count(*) > 1"


@query("g3_corpus_problems", f"""WITH {_CORPUS}, dup AS ({_DUP_URLS})
SELECT case_id, source_id, 'empty_id' AS problem, '' AS detail FROM corpus WHERE source_id = ''
UNION ALL SELECT case_id, source_id, 'duplicate_id', '' FROM (SELECT *, row_number() OVER (PARTITION BY case_id, source_id ORDER BY pos) AS n FROM corpus WHERE source_id <> '') WHERE n > 1
UNION ALL SELECT case_id, source_id, 'missing_title', '' FROM corpus WHERE source_id <> '' AND title = ''
UNION ALL SELECT case_id, source_id, 'suspect_domain', 'wikipedia' FROM corpus WHERE source_id <> '' AND contains(url, 'wikipedia')
UNION ALL SELECT case_id, source_id, 'missing_url', '' FROM corpus WHERE source_id <> '' AND url = ''
UNION ALL SELECT case_id, source_id, 'empty_access_status', '' FROM corpus WHERE source_id <> '' AND access_status = ''
UNION ALL SELECT case_id, source_id, 'missing_authority', '' FROM corpus WHERE source_id <> '' AND authority = ''
UNION ALL SELECT case_id, source_id, 'illegal_authority', authority FROM corpus WHERE source_id <> '' AND authority = 'E5'
UNION ALL SELECT case_id, source_id, 'missing_freshness', '' FROM corpus WHERE source_id <> '' AND freshness = ''
UNION ALL SELECT case_id, source_id, 'illegal_freshness', freshness FROM corpus WHERE source_id <> '' AND freshness = 'new'
UNION ALL SELECT case_id, source_id, 'superseded', '' FROM corpus WHERE source_id <> '' AND freshness = 'superseded'
UNION ALL SELECT case_id, source_id, 'illegal_origin', source_origin FROM corpus WHERE source_id <> '' AND source_origin = 'hacker'
UNION ALL SELECT case_id, '', 'duplicate_url', ids || ' ' || url FROM dup
UNION ALL SELECT case_id, '', 'journal_quota', count(*) FILTER (p_type = 'PROMO')::VARCHAR FROM corpus WHERE source_id <> '' GROUP BY case_id HAVING count(*) FILTER (p_type = 'PROMO') < 50""")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.problems(_corpus(spark, sf_dir), quota=50)


@query("a4_duplicate_url", f"WITH {_CORPUS} {_DUP_URLS}")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).where(F.trim("source_id") != "")
    return op.duplicate_urls(rows).withColumn("ids", F.array_join("ids", ","))


@query("a5_duplicate_ids", f"WITH {_CORPUS} SELECT case_id, source_id, count(*) - 1 AS extra FROM corpus WHERE source_id <> '' GROUP BY ALL HAVING count(*) > 1")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).where(F.trim("source_id") != "").groupBy("case_id", "source_id").agg((F.count("*") - 1).alias("extra")).where("extra > 0")


@query("a6_journal_quota", f"WITH {_CORPUS} SELECT case_id, count(*) FILTER (p_type = 'PROMO') AS journals, count(*) FILTER (p_type = 'PROMO') < 50 AS short FROM corpus GROUP BY case_id")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _corpus(spark, sf_dir).groupBy("case_id").agg(F.count_if(F.col("type") == "journal_paper").alias("journals"))
    return d.withColumn("short", F.col("journals") < 50)


@query("f9_enum_violations", f"WITH {_CORPUS} SELECT pos, authority, freshness FROM corpus WHERE authority = 'E5' OR freshness = 'new'")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = lambda c, v: (F.coalesce(F.col(c), F.lit("")) != "") & ~F.col(c).isin(*v)
    d = _corpus(spark, sf_dir).where(bad("authority", k.AUTHORITIES) | bad("freshness", k.FRESHNESS))
    return d.select("pos", "authority", F.coalesce("freshness", F.lit("")).alias("freshness"))


@query("f20_primary_sources", f"WITH {SOURCES_SQL} SELECT source_id FROM sources WHERE authority IN ('A1', 'A2', 'A3', 'B1', 'B2')")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.functions.evidence import is_primary

    return b.sources(spark, sf_dir).where(is_primary(F.col("authority"))).select("source_id")


@query("f27_access_populated", f"WITH {_CORPUS} SELECT case_id, bool_and(access_status <> '') AS populated FROM corpus GROUP BY case_id")
def f27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).groupBy("case_id").agg(F.every(F.coalesce(F.trim("access_status"), F.lit("")) != "").alias("populated"))


@query("p10_first_title", f"WITH {_CORPUS} SELECT pos, title FROM corpus")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("pos", filled(F.col("title"), F.col("title_or_name")).alias("title"))


_CATEGORIES = sorted(k.CATEGORY_RANKS)
_IDS = sorted(k.SOURCE_RANKS)


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a registry: every fifth has an id with an override, some a category without rank."""
    s = b.table(spark, sf_dir, "supplier")
    cat = F.element_at(F.array(*[F.lit(x) for x in [*_CATEGORIES, "ai_standard"]]), (F.col("s_suppkey") % (len(_CATEGORIES) + 1) + 1).cast("int"))
    own = F.element_at(F.array(*[F.lit(x) for x in _IDS]), (F.col("s_suppkey") % len(_IDS) + 1).cast("int"))
    return s.select(F.when(F.col("s_suppkey") % 5 == 0, own).otherwise(F.concat(F.lit("r"), F.col("s_suppkey").cast("string"))).alias("id"), cat.alias("category"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))


def _rank_sql(i: int, other: str) -> str:
    quoted = (lambda v: f"'{v}'") if i == 0 else str
    ids = " ".join(f"WHEN '{x}' THEN {quoted(r[i])}" for x, r in k.SOURCE_RANKS.items())
    cats = " ".join(f"WHEN '{x}' THEN {quoted(r[i])}" for x, r in k.CATEGORY_RANKS.items())
    return f"coalesce(CASE id {ids} END, CASE category {cats} END, {other})"


_REGISTRY = f"""registry AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 5 = 0 THEN list_extract({_IDS!r}, (s_suppkey % {len(_IDS)} + 1)::INT) ELSE 'r' || s_suppkey END AS id,
  list_extract({[*_CATEGORIES, 'ai_standard']!r}, (s_suppkey % {len(_CATEGORIES) + 1} + 1)::INT) AS category FROM supplier)"""
_MATERIALS = "('materials_data', 'materials_engineering_data', 'materials_scientific_database', 'international_standard', 'china_standard', 'nuclear_data', 'technical_report_library', 'cross_technical_report_library', 'scholarly_index')"


@query("j6_registry_rank", f"WITH {_REGISTRY} SELECT key, id, category, {_rank_sql(0, repr(''))} AS authority, {_rank_sql(1, '50')} AS priority FROM registry")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ranked(_registry(spark, sf_dir)).select("key", "id", "category", "authority", "priority")


@query("g13_select", f"WITH {_REGISTRY} SELECT key, id, {_rank_sql(1, '50')} AS priority, contains(category, 'standard') AS verify_current FROM registry WHERE category IN {_MATERIALS}")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.selected(_registry(spark, sf_dir), "materials").select("key", "id", "priority", "verify_current")


@query("a20_category_counts", f"WITH {_REGISTRY} SELECT count(*) AS selected, count(DISTINCT category) AS categories FROM registry WHERE category IN {_MATERIALS}")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.selected(_registry(spark, sf_dir), "materials").agg(F.count("*").alias("selected"), F.count_distinct("category").alias("categories"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


@query("p19_directive", f"SELECT page_id, 'site:' || {_HOST} || CASE WHEN page_id % 2 = 0 THEN ' —— 可取全文/下载PDF；' ELSE ' —— 仅取题录/摘要与文档编号，禁止虚构全文；' END || 'page ' || page_id AS directive FROM pages")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", urls.directive(F.col("url"), F.col("page_id") % 2 == 0, F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("directive"))


_DOMAINS = ("casino", "free-bets", "example.org/en")


@query("j10_suspect_domain", "SELECT page_id, CASE WHEN contains(url, 'casino') THEN 'casino' WHEN contains(url, 'free-bets') THEN 'free-bets' WHEN contains(url, 'example.org/en') THEN 'example.org/en' END AS domain FROM pages")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 too: the first domain in order, without a join."""
    return b.table(spark, sf_dir, "pages").select("page_id", urls.suspect_domain(F.col("url"), _DOMAINS).alias("domain"))


_SUFFIXES = (".example.org", "net", ".Example.com")


@query("f4_suffix", f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, CASE WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN '.example.org' WHEN host = 'net' OR ends_with(host, '.net') THEN '.net' WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN '.example.com' END AS suffix FROM h")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", urls.suspect_suffix(urls.host_of(F.col("url")), _SUFFIXES).alias("suffix"))


_IP = "(ip_a || '.' || ip_b || '.' || (user_id % 256) || '.' || (event_id % 256))"
_IPS = "ips AS (SELECT event_id, list_extract([10, 127, 169, 172, 192, 8, 100, 203], (event_id % 8 + 1)::INT) AS ip_a, list_extract([0, 254, 16, 168, 64, 8], (event_id // 8 % 6 + 1)::INT) AS ip_b, user_id FROM events)"


@query("f6_private_ip", f"""WITH {_IPS} SELECT event_id, {_IP} AS host, ip_a IN (10, 127) OR (ip_a = 169 AND ip_b = 254) OR (ip_a = 172 AND ip_b BETWEEN 16 AND 31) OR (ip_a = 192 AND ip_b = 168)
  OR (ip_a = 192 AND ip_b = 0 AND user_id % 256 IN (0, 2)) OR (ip_a = 100 AND ip_b BETWEEN 64 AND 127) OR (ip_a = 203 AND ip_b = 0 AND user_id % 256 = 113) AS private FROM ips""")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int")).cast("string")
    e = b.table(spark, sf_dir, "events")
    ip = F.concat_ws(".", pick((10, 127, 169, 172, 192, 8, 100, 203), F.col("event_id") % 8), pick((0, 254, 16, 168, 64, 8), F.floor(F.col("event_id") / 8) % 6), (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"))
    return e.select("event_id", ip.alias("host")).withColumn("private", urls.private_v4(F.col("host")))


_V6 = (("2001", True), ("2001:db8", True), ("2002:7f00", True), ("2606:2800", False), ("fd00", True), ("fe80", True), ("::ffff:8", True), ("2001:20", False), ("2001:4:112", False), ("2001:200", False), ("ff02", True), ("64:ff9b", True), ("2a00:1450", False))


@query("f6_private_ipv6", f"""WITH nets(i, prefix, hidden) AS (VALUES {", ".join(f"({i}, '{x}', {hidden})" for i, (x, hidden) in enumerate(_V6))})
SELECT event_id, '[' || prefix || CASE WHEN prefix LIKE '::%' THEN ':' ELSE '::' END || lower(format('{{:x}}', user_id % 65536)) || ']' AS host, hidden AS private FROM events JOIN nets ON i = event_id % {len(_V6)}""")
def f6_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*[F.lit(x) for x, _ in _V6]), (F.col("event_id") % len(_V6) + 1).cast("int"))
    host = F.concat(F.lit("["), prefix, F.when(prefix.startswith("::"), ":").otherwise("::"), F.lower(F.hex(F.col("user_id") % 65536)), F.lit("]"))
    return b.table(spark, sf_dir, "events").select("event_id", host.alias("host")).withColumn("private", urls.private_ip(F.col("host")))


@query("f6_numeric_hosts", """WITH x AS (SELECT event_id, (event_id * 7919 + user_id * 104729) % 4294967296 AS n FROM events), y AS (SELECT *, n // 16777216 AS a, n // 65536 % 256 AS b, n // 256 % 256 AS c, n % 256 AS d FROM x)
SELECT event_id, coalesce(a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2) AND NOT (c = 0 AND d IN (9, 10))))) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113), false) AS private FROM y""")
def f6_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses written as one number, as two or three parts, in octal or hexadecimal."""
    n = (F.col("event_id") * 7919 + F.col("user_id") * 104729) % (1 << 32)
    part = lambda low, size: F.floor(n / (1 << low)).cast("long") % (1 << size)
    text = lambda x: x.cast("string")
    host = F.when(F.col("event_id") % 5 == 0, text(n)).when(F.col("event_id") % 5 == 1, F.concat(F.lit("0x"), F.lower(F.hex(n)))).when(F.col("event_id") % 5 == 2, F.concat_ws(".", text(part(24, 8)), text(part(0, 24)))) \
        .when(F.col("event_id") % 5 == 3, F.concat_ws(".", F.concat(F.lit("0"), F.conv(text(part(24, 8)), 10, 8)), text(part(16, 8)), text(part(0, 16)))).otherwise(F.concat_ws(".", *[F.concat(F.lit("0x"), F.hex(part(i, 8))) for i in (24, 16, 8, 0)]))
    return b.table(spark, sf_dir, "events").select("event_id", urls.numeric_host(F.lower(host)).alias("private"))


@query("f7_url_policy", f"""WITH h AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ftp' WHEN 1 THEN 'http' ELSE 'https' END || '://' || CASE page_id % 7 WHEN 0 THEN 'localhost' WHEN 1 THEN 'box.local' WHEN 2 THEN '10.1.2.' || (page_id % 256) WHEN 3 THEN 'a.test' WHEN 4 THEN '8.8.8.8' ELSE 'public.com' END AS url FROM pages)
SELECT page_id, CASE WHEN page_id % 7 = 3 OR page_id % 7 = 0 THEN 'suspect_suffix' WHEN page_id % 5 = 0 THEN 'scheme' WHEN page_id % 7 = 1 THEN 'blocked_host' WHEN page_id % 7 IN (2, 5) OR (page_id % 7 = 6 AND page_id % 2 = 0) THEN 'private_ip' END AS reason FROM h""")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, F8 too: reasons in order, the cheap ones first."""
    key = F.col("page_id")
    scheme = F.when(key % 5 == 0, "ftp").when(key % 5 == 1, "http").otherwise("https")
    host = F.when(key % 7 == 0, "localhost").when(key % 7 == 1, "box.local").when(key % 7 == 2, F.concat(F.lit("10.1.2."), (key % 256).cast("string"))).when(key % 7 == 3, "a.test").when(key % 7 == 4, "8.8.8.8").when(key % 7 == 5, F.concat(F.lit("[fd00::"), (key % 10).cast("string"), F.lit("]:8080"))).otherwise("public.com")
    answers = F.when((key % 7 == 6) & (key % 2 == 0), F.array(F.lit("93.184.216.34"), F.lit("::1"))).otherwise(F.array(F.lit("2606:2800:220:1::1")))
    return b.table(spark, sf_dir, "pages").select("page_id", urls.policy(F.concat(scheme, F.lit("://"), host), answers=answers).alias("reason"))


_LANDING = ["https://www.osti.gov/biblio/{}-x", "https://www.osti.gov/servlets/purl/{}", "https://www.mdpi.com/2073-4441/12/3/{}/", "https://hal.science/hal-{}/", "https://www.nature.com/articles/s{}", "https://iopscience.iop.org/article/10.1088/a{}", "https://bmc.biomedcentral.com/articles/10.1186/s{}?x=1", "https://www.frontiersin.org/articles/10.3389/f.{}/full", "https://pmc.ncbi.nlm.nih.gov/articles/PMC{}/", "https://host.org/{}"]
_DIRECT = ["https://www.osti.gov/servlets/purl/{}", "https://www.osti.gov/servlets/purl/{}", "https://www.mdpi.com/2073-4441/12/3/{}/pdf", "https://hal.science/hal-{}/document", "https://www.nature.com/articles/s{}.pdf", "https://iopscience.iop.org/article/10.1088/a{}/pdf", "https://bmc.biomedcentral.com/counter/pdf/10.1186/s{}.pdf", "https://www.frontiersin.org/articles/10.3389/f.{}/pdf", "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC{}/pdf/main.pdf"]


@query("p28_fix_pdf_url", "SELECT p_partkey, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN replace('{x}', '{{}}', p_partkey::VARCHAR)" for i, x in enumerate(_DIRECT)) + " END AS pdf FROM part")
def p28(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = lookup(F.col("p_partkey") % 10, dict(enumerate(_LANDING)), "")
    d = b.table(spark, sf_dir, "part").select("p_partkey", F.replace(url, F.lit("{}"), F.col("p_partkey").cast("string")).alias("url"))
    return d.select("p_partkey", urls.pdf_url(F.col("url")).alias("pdf"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sources that several files name, with URLs missing here and there."""
    l = b.table(spark, sf_dir, "lineitem")
    one = l.groupBy(F.col("l_linenumber").alias("file"), F.col("l_partkey").alias("pos")).agg(F.min("l_suppkey").alias("s"))
    url = F.when(F.col("s") % 3 == 0, F.concat(F.lit("https://x.org/"), (F.col("pos") * 2 + F.col("s") % 2).cast("string")))
    return one.select("file", "pos", F.when(F.col("pos") % 97 != 0, F.col("pos").cast("string")).otherwise("").alias("id"), url.alias("url"))


@query("sc3_collect", """WITH f AS (SELECT l_linenumber AS file, l_partkey AS pos, CASE WHEN l_partkey % 97 <> 0 THEN l_partkey::VARCHAR ELSE '' END AS id, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
g AS (SELECT *, CASE WHEN s % 3 = 0 THEN 'https://x.org/' || (pos * 2 + s % 2) END AS url FROM f),
h AS (SELECT file, pos, id, coalesce(url, first_value(url IGNORE NULLS) OVER (PARTITION BY id ORDER BY file, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS url FROM g)
SELECT file, pos, id, url FROM h WHERE id <> '' AND url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, url ORDER BY file, pos) = 1""")
def sc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, U6 too."""
    return op.collected(_files(spark, sf_dir))


_STATUS = ("downloaded", "exists", "not_pdf", "failed", "blocked_ssrf", "dry_run")


@query("sk4_access_status", f"""WITH {SOURCES_SQL}, d AS (SELECT l_partkey, list_extract({list(_STATUS)!r}, (max_by(l_suppkey, l_orderkey * 8 + l_linenumber) % 6 + 1)::INT) AS status FROM
  (SELECT l_partkey, l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) GROUP BY l_partkey)
SELECT source_key, coalesce(CASE status WHEN 'downloaded' THEN 'confirmed' WHEN 'exists' THEN 'confirmed' WHEN 'not_pdf' THEN 'web_accessible' WHEN 'failed' THEN 'unavailable' END, 'pending') AS access_status FROM sources LEFT JOIN d ON source_key = l_partkey""")
def sk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 too."""
    l = b.table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"))
    d = l.select(F.col("l_partkey").alias("source_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), lookup(F.col("s") % 6, dict(enumerate(_STATUS)), "").alias("status"))
    corpus = b.sources(spark, sf_dir).select(F.col("source_key").alias("source_id"), F.lit("pending").alias("access_status"))
    return op.write_back(corpus, d).select(F.col("source_id").alias("source_key"), "access_status")


@query("a14_status_histogram", f"SELECT list_extract({list(_STATUS)!r}, (l_suppkey % 6 + 1)::INT) AS status, count(*) AS n FROM lineitem GROUP BY ALL")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "lineitem").groupBy(lookup(F.col("l_suppkey") % 6, dict(enumerate(_STATUS)), "").alias("status")).agg(F.count("*").alias("n"))


@query("f1_role_filter", "SELECT p_partkey FROM part WHERE p_partkey % 4 = 0 OR p_type IN ('PROMO', 'SMALL')")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part").withColumn("role", F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")))
    return p.where(op.role_allowed(["PROMO", "SMALL"])).select("p_partkey")


@query("f2_domain_routing", f"""WITH {_REGISTRY} SELECT key, id, 'energy' AS domain FROM registry WHERE category IN ('energy_international', 'energy_data', 'government_agency', 'national_lab', 'china_regulator', 'china_technical', 'industry_technical')
  UNION ALL SELECT key, id, 'education' FROM registry WHERE category LIKE 'education_%' OR category IN ('china_regulator', 'scholarly_index')
  UNION ALL SELECT key, id, 'general' FROM registry""")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [op.selected(_registry(spark, sf_dir), d).select("key", "id", F.lit(d).alias("domain")) for d in ("energy", "education", "general")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("w8_next_ids", "WITH used AS (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0), free AS (SELECT x, row_number() OVER (ORDER BY x) AS n FROM range(1, 4000000) t(x) WHERE x NOT IN (SELECT p_partkey FROM used)), new AS (SELECT s_suppkey AS pos, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) SELECT pos, 'S' || x AS source_id FROM new JOIN free USING (n)")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = b.table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("source_id"))
    return op.next_ids(b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos")), used)


@query("t1_registry_order", f"WITH {_REGISTRY}, r AS (SELECT key, id, {_rank_sql(1, '50')} AS priority FROM registry) SELECT key, id, priority, row_number() OVER (ORDER BY priority DESC, id, key) AS place FROM r")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ranked(_registry(spark, sf_dir)).select("key", "id", "priority", F.row_number().over(Window.orderBy(F.desc("priority"), "id", "key")).cast("long").alias("place"))
