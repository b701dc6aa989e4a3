"""Queries over manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import contracts as k
from attesta.functions.evidence import lookup
from attesta.operators import claims as claims_op
from attesta.operators import manifests as op
from attesta.plans import bindings as b
from attesta.plans.bindings import CLAIMS_SQL, DRAFTS_SQL, EVIDENCE_SQL, GRAPH_SQL
from attesta.plans.draft_queries import _NUMBERS
from attesta.plans.registry import query

_DAY = "2026-01-01"


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = claims_op.edges_with_sources(b.evidence(spark, sf_dir), b.sources(spark, sf_dir))
    return op.claim_manifests(b.claims(spark, sf_dir), edges, _DAY)


@query("p17_claim_manifest", f"""WITH {GRAPH_SQL} SELECT case_key, claim_id, claim_class, risk, e.source_id, support_level, relation, authority, freshness, page, section
  FROM claims LEFT JOIN evidence e USING (claim_key) LEFT JOIN sources USING (source_key)""")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests as JSON, read back."""
    d = _manifests(spark, sf_dir).select("case_key", F.explode(F.from_json("manifest", op.MANIFEST)["claims"]).alias("c"))
    e = d.select("case_key", "c.*", F.explode_outer("c.evidence").alias("e"))
    return e.select("case_key", "claim_id", "claim_class", "risk", "e.source_id", "e.support_level", "e.relation", "e.authority", "e.freshness", F.col("e.locator.page").alias("page"), F.col("e.locator.section").alias("section"))


@query("g14_provenance_problems", f"WITH {CLAIMS_SQL}, {EVIDENCE_SQL} SELECT count(*) AS problems FROM evidence JOIN claims USING (claim_key) WHERE source_id LIKE 'G%'")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is assembled keeps the contract, but for evidence that isn't a source's."""
    d = _manifests(spark, sf_dir).select(F.col("case_key").alias("doc_id"), F.col("manifest").alias("json"))
    return op.contract_problems(d).agg(F.count("*").alias("problems"))


def _bundles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every customer a case: its claim manifest, and a source manifest with a citation of its number, malformed for every sixth, absent for every seventh."""
    c = b.table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0")
    key = F.col("c_custkey").cast("string")
    cited = F.concat(F.when(F.col("c_custkey") % 6 == 0, "S").otherwise("[S"), key, F.lit("]"))
    entry = F.array(F.struct(cited.alias("citation"), F.lit("[1]").alias("mapped"), F.concat(F.lit("S"), key).alias("source_id")))
    head = [F.lit(x).alias(n) for n, x in (("schema_version", op.SCHEMA_VERSION), ("review_kind", "ai-internal"), ("verification_mode", "static"), ("finalized_at", _DAY))]
    maps = c.select(F.col("c_custkey").alias("case_key"), F.to_json(F.struct(*head, entry.alias("mapping"))).alias("manifest"))
    reviews = c.select(F.col("c_custkey").alias("case_key"), F.lit("10_review.md").alias("file"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("**判决**：通过 "), key)).otherwise("none").alias("text"))
    edges = claims_op.edges_with_sources(b.evidence(spark, sf_dir).where(F.col("source_id").startswith("S") | (F.col("claim_key") % 3 == 0)), b.sources(spark, sf_dir))
    return op.bundles(b.claims(spark, sf_dir), edges, maps, reviews, _DAY)


_BUNDLES_SQL = f"""{CLAIMS_SQL}, {EVIDENCE_SQL}, cases AS (SELECT case_key FROM claims UNION SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0),
bad AS (SELECT DISTINCT case_key FROM claims JOIN evidence USING (claim_key) WHERE source_id LIKE 'G%' AND claim_key % 3 = 0),
judged AS (SELECT case_key, case_key IN (SELECT case_key FROM bad) AS claims_bad, case_key % 7 = 0 OR case_key NOT IN (SELECT c_custkey FROM customer) AS absent, case_key % 6 = 0 AS malformed FROM cases)"""


@query("sk8_bundles", f"""WITH {_BUNDLES_SQL}, good AS (SELECT case_key FROM judged WHERE NOT claims_bad AND NOT absent AND NOT malformed)
SELECT case_key, unnest(['claims', 'evidence', 'source-map', 'review']) AS report, unnest([(SELECT count(*) FROM claims c WHERE c.case_key = good.case_key), 1, 1, (case_key % 2 = 0)::BIGINT])::BIGINT AS entries FROM good""")
def sk8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four reports of each case that keeps the contract, with how many entries each has."""
    n = lambda name: F.json_array_length(F.get_json_object("json", f"$.{name}"))
    return _bundles(spark, sf_dir)[0].select("case_key", "report", F.coalesce(n("claims"), n("mapping"), n("stages")).cast("long").alias("entries"))


@query("g14_bundle_problems", f"""WITH {_BUNDLES_SQL} SELECT case_key, 'claims' AS manifest FROM judged WHERE claims_bad UNION ALL SELECT case_key, 'evidence' FROM judged WHERE absent OR malformed""")
def g14_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundles(spark, sf_dir)[1].select("case_key", "manifest").distinct()


@query("p18_source_manifest", f"""WITH {DRAFTS_SQL}, {_NUMBERS}, s AS (SELECT 'S' || p_partkey AS sid, p_name FROM part WHERE p_partkey % 13 <> 0)
SELECT doc_id, '[S' || key || ']' AS citation, '[' || n || ']' AS mapped, 'S' || key AS source_id, p_name AS title, '0.2.0' AS version, '2026-01-01' AS day, 'none' AS human FROM numbers LEFT JOIN s ON sid = 'S' || key""")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.plans.draft_queries import w2

    e = b.evidence(spark, sf_dir).groupBy(F.col("claim_key").alias("doc_id"), F.col("source_key").cast("string").alias("key")).agg(F.collect_list(F.struct("support_level")).alias("claims"))
    human = F.struct(F.lit("none").alias("human_involvement"), F.lit(True).alias("context_shared"))
    m = op.source_manifests(w2(spark, sf_dir), b.sources(spark, sf_dir), e, _DAY, notice="public sources only", independence=human)
    entry = "array<struct<citation:string,mapped:string,source_id:string,title:string>>"
    rows = m.select("doc_id", F.from_json("manifest", f"struct<schema_version:string,finalized_at:string,review_independence:struct<human_involvement:string>,mapping:{entry}>").alias("j"))
    rows = rows.select("doc_id", F.explode("j.mapping").alias("m"), F.col("j.schema_version").alias("version"), F.col("j.finalized_at").alias("day"), F.col("j.review_independence.human_involvement").alias("human"))
    return rows.select("doc_id", "m.*", "version", "day", "human")


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of customers with all that the contract forbids, as JSON text."""
    text = lambda c: F.col(c).cast("string")
    q = lambda name, v: F.concat(F.lit(f'"{name}":"'), v, F.lit('"'))
    e = b.evidence(spark, sf_dir)
    level = F.when(F.col("source_key") % 19 == 0, "bogus").otherwise(F.col("support_level"))
    place = F.when(F.col("line") == 3, ',"locator":{"page":"x"}').when(F.col("line") == 5, ',"locator":{"foo":1,"locator_quality":"low"}').when(F.col("line") == 7, ',"locator":"p. 3"').otherwise(',"locator":{"page":4,"quote_hash":null}')
    edge = F.concat(F.lit("{"), q("source_id", F.concat(F.when(F.col("source_key") % 29 == 0, "X").otherwise("S"), F.abs("source_key").cast("string"))), F.lit(","), q("support_level", level), F.when(F.col("source_key") % 37 == 0, ',"relation":"rejects"').otherwise(',"relation":null'), place, F.lit("}"))
    lists = e.groupBy("claim_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_key", edge.alias("t")))), lambda x: x["t"]), ",").alias("es"))
    c = b.claims(spark, sf_dir).join(lists, "claim_key", "left")
    key = F.col("claim_key")
    claim = F.concat(
        F.lit("{"), q("claim_id", F.when(key % 31 == 0, "C-1").otherwise(F.col("claim_id"))), F.lit(","), q("claim_class", F.when(key % 17 == 0, "X").otherwise(F.col("claim_class"))),
        F.when(key % 23 == 0, "").otherwise(',"claim_text":"t"'), F.when(key % 41 == 0, ',"confidence":"certain"').otherwise(""), F.when(key % 43 == 0, ',"interpretation":7').otherwise(""),
        F.when(key % 47 == 0, ',"evidence":"none"').otherwise(F.concat(F.lit(',"evidence":['), F.coalesce("es", F.lit("")), F.lit("]"))), F.lit("}"),
    )
    cases = c.groupBy("case_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("claim_key", claim.alias("t")))), lambda x: x["t"]), ",").alias("cs"))
    case = F.col("case_key")
    json = F.concat(
        F.lit('{"schema_version":"'), lookup(case % 3, {0: "0.2.0", 1: "0.1.0"}, "9.9.9"), F.lit('"'), F.when(case % 5 == 0, "").otherwise(',"review_kind":"ai-internal"'), F.lit(',"verification_mode":'), F.when(case % 7 == 0, '"sometimes"').otherwise('"live"'),
        F.when(case % 11 == 0, ',"finalized_at":"2026-13-01"').otherwise(',"finalized_at":"2026-01-01"'), F.when(case % 13 == 0, ',"review_independence":{"context_shared":"yes","human_involvement":"maybe"}').otherwise(""), F.lit(',"claims":['), F.col("cs"), F.lit("]}"),
    )
    return cases.select(F.col("case_key").alias("doc_id"), json.alias("json"))


@query("g8_manifest_contract", f"""WITH {CLAIMS_SQL}, {EVIDENCE_SQL}, c AS (SELECT *, 'claims[' || (row_number() OVER (PARTITION BY case_key ORDER BY claim_key) - 1) || ']' AS path, CASE WHEN claim_key % 31 = 0 THEN 'C-1' ELSE claim_id END AS cid FROM claims),
cases AS (SELECT DISTINCT case_key FROM claims), e AS (SELECT e.*, c.case_key, c.path || '.evidence[' || (row_number() OVER (PARTITION BY claim_key ORDER BY source_key) - 1) || ']' AS epath FROM evidence e JOIN c USING (claim_key) WHERE claim_key % 47 <> 0)
SELECT case_key AS doc_id, '' AS path, 'schema_version' AS problem FROM cases WHERE case_key % 3 = 2
UNION ALL SELECT case_key, '', 'missing review_kind' FROM cases WHERE case_key % 5 = 0
UNION ALL SELECT case_key, '', 'illegal verification_mode' FROM cases WHERE case_key % 7 = 0
UNION ALL SELECT case_key, '', 'finalized_at is no date' FROM cases WHERE case_key % 11 = 0
UNION ALL SELECT case_key, 'review_independence', unnest(['context_shared must be a boolean', 'illegal human_involvement']) FROM cases WHERE case_key % 13 = 0
UNION ALL SELECT case_key, path, 'illegal claim_class' FROM c WHERE claim_key % 17 = 0
UNION ALL SELECT case_key, path, 'missing claim_text' FROM c WHERE claim_key % 23 = 0
UNION ALL SELECT case_key, path, 'illegal confidence' FROM c WHERE claim_key % 41 = 0
UNION ALL SELECT case_key, path, 'interpretation must be a string' FROM c WHERE claim_key % 43 = 0
UNION ALL SELECT case_key, path, 'evidence must be an array' FROM c WHERE claim_key % 47 = 0
UNION ALL SELECT case_key, path, 'duplicate claim_id' FROM (SELECT *, row_number() OVER (PARTITION BY case_key, cid ORDER BY claim_key) AS n FROM c) WHERE n > 1
UNION ALL SELECT case_key, epath, 'illegal support_level' FROM e WHERE source_key % 19 = 0
UNION ALL SELECT case_key, epath, 'source_id format' FROM e WHERE source_key % 29 = 0
UNION ALL SELECT case_key, epath, 'illegal relation' FROM e WHERE source_key % 37 = 0
UNION ALL SELECT case_key, epath, 'locator.page must be an integer' FROM e WHERE line = 3
UNION ALL SELECT case_key, epath, 'locator has an unknown key' FROM e WHERE line = 5
UNION ALL SELECT case_key, epath, 'locator must be an object' FROM e WHERE line = 7""")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 to F14, A5 too."""
    return op.contract_problems(_broken(spark, sf_dir))


@query("g8_warnings", "SELECT DISTINCT o_custkey AS doc_id, '0.1.0' AS version FROM orders WHERE o_custkey % 3 = 1")
def g8_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.warnings(_broken(spark, sf_dir))


@query("f12_dates", "SELECT o_orderkey, o_orderkey % 4 = 1 AS is_date FROM orders")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.table(spark, sf_dir, "orders")
    v = lookup(F.col("o_orderkey") % 4, {0: "2026-13-01", 1: "2026-02-28", 2: "2026"}, "2026-8-2")
    strict = v.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return o.select("o_orderkey", (strict & F.when(strict, v).try_cast("date").isNotNull()).alias("is_date"))


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of the old version: no relations."""
    d = _manifests(spark, sf_dir)
    old = F.regexp_replace(F.replace(F.col("manifest"), F.lit('"schema_version":"0.2.0"'), F.lit('"schema_version":"0.1.0"')), r',"relation":"[a-z_]+"', "")
    return d.select(F.col("case_key").alias("doc_id"), old.alias("json"))


@query("g11_migrate", f"""WITH {CLAIMS_SQL}, {EVIDENCE_SQL} SELECT case_key AS doc_id, '0.2.0' AS version, true AS context_shared, count(e.source_key) FILTER (relation = 'supports') AS supports, count(e.source_key) FILTER (relation = 'contradicts') AS contradicts, count(e.source_key) FILTER (relation = 'context_only') AS context_only, true AS idempotent
  FROM claims LEFT JOIN evidence e USING (claim_key) GROUP BY case_key""")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _legacy(spark, sf_dir).withColumn("json", op.migrated("json"))
    d = d.withColumns({"m": F.from_json("json", op.MANIFEST), "again": op.migrated("json"), "shared": F.get_json_object("json", "$.review_independence.context_shared").cast("boolean")})
    rel = F.flatten(F.transform("m.claims", lambda c: F.transform(c["evidence"], lambda e: e["relation"])))
    n = lambda r: F.size(F.filter(rel, lambda x: x == r)).cast("long").alias(r)
    return d.select("doc_id", F.col("m.schema_version").alias("version"), F.col("shared").alias("context_shared"), n("supports"), n("contradicts"), n("context_only"), (F.col("again") == F.col("json")).alias("idempotent"))


@query("j13_migration_changes", f"WITH {CLAIMS_SQL}, {EVIDENCE_SQL} SELECT case_key AS doc_id, source_id, relation FROM claims JOIN evidence USING (claim_key)")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _legacy(spark, sf_dir)
    return op.migration_changes(before, before.withColumn("json", op.migrated("json"))).select("doc_id", "source_id", "relation")


@query("p32_verdicts", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'r4 初稿审查' WHEN 1 THEN '终审门' ELSE 'notes' END AS stage, '通过 ' || conv_id AS verdict FROM conversations WHERE turn % 5 <> 4")
def p32(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 5 != 4, F.concat(F.lit("# Review\n**判决**： 通过 "), F.col("conv_id").cast("string"), F.lit(" \nend"))).otherwise("no verdict")
    d = c.select("conv_id", "turn", lookup(F.col("turn") % 3, {0: "10_review.md", 1: "final_gate_a.md"}, "notes.md").alias("file"), text.alias("text"))
    return op.verdicts(d).select("conv_id", "turn", "stage", "verdict")


@query("f14_locator_keys", f"WITH {EVIDENCE_SQL} SELECT claim_key, source_key FROM evidence WHERE line = 5")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.evidence(spark, sf_dir).withColumn("l", F.when(F.col("line") == 5, '{"foo":1,"page":2}').otherwise('{"page":2}'))
    return e.where(F.size(F.array_except(F.json_object_keys("l"), F.array(*[F.lit(x) for x in k.LOCATOR_KEYS]))) > 0).select("claim_key", "source_key")
