"""Manifests: assembly from the graph, contract checks, migration, provenance bundle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta import contracts as k
from attesta.functions.evidence import blank, filled, given_place, id_of, lookup, place_of, relation_of

SCHEMA_VERSION, LEGACY_VERSIONS = "0.2.0", {"0.1.0": "0.2.0"}
# Enumerations of the contract.
REVIEW_KINDS = ("ai-internal", "ai-cross-model", "human-expert")
MANIFEST_MODES = ("static", "live")
EVIDENCE_STATUSES = ("verified", "supported", "partially_supported", "inferred", "contradicted", "unsupported", "unverified", "internal_confirm")
#: Stage of a review by the beginning of its file's name.
STAGES = {"03_audit_report": "r1 来源审计", "07_honest_assessment": "r2 诚实性自评", "10_review": "r4 初稿审查", "12_外部专家意见": "r5 外部专家评审", "final_gate": "终审门"}
EVIDENCE = T.StructType([*[T.StructField(x, T.StringType()) for x in ("source_id", "support_level", "relation", "authority", "freshness")], T.StructField("locator", k.LOCATOR)])
CLAIM = T.StructType([*[T.StructField(x, T.StringType()) for x in ("claim_id", "claim_class", "risk", "claim_text", "evidence_status", "verdict", "confidence", "interpretation")], T.StructField("evidence", T.ArrayType(EVIDENCE))])
MANIFEST = T.StructType([*[T.StructField(x, T.StringType()) for x in ("schema_version", "review_kind", "verification_mode", "finalized_at")], T.StructField("claims", T.ArrayType(CLAIM))])


def claim_manifests(claims: DataFrame, edges: DataFrame, finalized_at: str, review_kind: str = "ai-internal", mode: str = "static") -> DataFrame:
    """(case_key, manifest) from claims and their edges with authority and freshness; fields without value are left out, as to_json does.

    An edge's locator has the fields it was recorded with, no others. Claims may have claim_text, evidence_status, verdict, confidence
    and interpretation. Two aggregations, by claim and by case; claims and edges keep the order of their keys.
    """
    nonblank = lambda x: F.when(~blank(x), F.trim(x))
    place = place_of(edges)
    locator = F.when(given_place(edges), F.struct(*[x.alias(name) for name, x in place.items()]))
    parts = F.struct(id_of(edges).alias("source_id"), "support_level", "relation", nonblank(F.col("authority")).alias("authority"), nonblank(F.col("freshness")).alias("freshness"), locator.alias("locator"))
    e = F.struct("source_key", parts.alias("e")).alias("e")
    lists = edges.groupBy("claim_key").agg(F.sort_array(F.collect_list(e)).alias("es"))
    d = claims.join(lists, "claim_key", "left")
    evidence = F.coalesce(F.transform("es", lambda x: x["e"]), F.array().cast(T.ArrayType(EVIDENCE)))
    text = F.col("claim_text") if "claim_text" in claims.columns else F.concat(F.lit("claim "), F.col("claim_key").cast("string"))
    more = [nonblank(F.col(x) if x in claims.columns else F.lit(None).cast("string")).alias(x) for x in ("evidence_status", "verdict", "confidence", "interpretation")]
    c = F.struct("claim_key", F.struct("claim_id", "claim_class", "risk", text.alias("claim_text"), evidence.alias("evidence"), *more).alias("c"))
    cases = d.groupBy("case_key").agg(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["c"]).alias("claims"))
    head = [F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(review_kind).alias("review_kind"), F.lit(mode).alias("verification_mode"), F.lit(finalized_at).alias("finalized_at")]
    return cases.select("case_key", F.to_json(F.struct(*head, "claims")).alias("manifest"))


def source_manifests(numbers: DataFrame, sources: DataFrame, claims_by_source: DataFrame, finalized_at: str, review_kind: str = "ai-internal", mode: str = "static", notice: str | None = None, independence: Column | None = None) -> DataFrame:
    """(doc_id, manifest) from numbered keys (doc_id, key, n), in order of number, with what is known of each source and its claims.

    `claims_by_source` has (doc_id, key, claims); `notice` says what the evidence doesn't reach, `independence` is a struct of the review's.
    """
    d = numbers.join(sources.select(F.col("source_id").alias("sid"), "title", "url"), F.concat(F.lit("S"), F.col("key")) == F.col("sid"), "left").join(claims_by_source, ["doc_id", "key"], "left")
    entry = F.struct(F.concat(F.lit("[S"), F.col("key"), F.lit("]")).alias("citation"), F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]")).alias("mapped"), F.concat(F.lit("S"), F.col("key")).alias("source_id"), F.when(~blank(F.col("title")), F.col("title")).alias("title"), F.when(~blank(F.col("url")), F.col("url")).alias("url"), "claims")
    mapping = F.transform(F.sort_array(F.collect_list(F.struct("n", entry.alias("e")))), lambda x: x["e"]).alias("mapping")
    head = [F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(review_kind).alias("review_kind"), F.lit(mode).alias("verification_mode"), F.lit(finalized_at).alias("finalized_at")]
    head += [] if notice is None else [F.lit(notice).alias("boundary_notice")]
    head += [] if independence is None else [independence.alias("review_independence")]
    return d.groupBy("doc_id").agg(mapping).select("doc_id", F.to_json(F.struct(*head, "mapping")).alias("manifest"))


def _kind(v: Column) -> Column:
    """The type of a scalar; of nothing, VOID."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _object(v: Column) -> Column:
    """The members of an object; null of anything else. A member that is null is there, an absent one isn't."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))


def _bad(v: Column, allowed: tuple[str, ...]) -> Column:
    """Present, not null, and not one of `allowed`."""
    kind = _kind(v)
    return (kind != "VOID") & ~((kind == "STRING") & _text(v).isin(*allowed))


def _found(path: Column, checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(x, F.struct(path.alias("path"), F.lit(p).alias("problem"))) for x, p in checks]))


def _place(name: str, i: Column, rest: Column | None = None) -> Column:
    parts = [F.lit(f"{name}["), i.cast("string"), F.lit("]")]
    return F.concat(*parts) if rest is None else F.concat(rest, F.lit("."), *parts)


def _root_problems(m: Column) -> Column:
    version, date, review = _text(m["schema_version"]), _text(m["finalized_at"]), m["review_independence"]
    absent = lambda x: m[x].isNull()
    form = date.rlike(r"^\d{4}-\d{2}-\d{2}$")
    r = _object(review)
    typed = lambda key, kind: r.isNotNull() & ~_kind(r[key]).isin(kind, "VOID")
    return F.concat(_found(F.lit(""), [
        (~version.isin(SCHEMA_VERSION, *LEGACY_VERSIONS), "schema_version"),
        (absent("review_kind"), "missing review_kind"), (_bad(m["review_kind"], REVIEW_KINDS), "illegal review_kind"),
        (absent("verification_mode"), "missing verification_mode"), (_bad(m["verification_mode"], MANIFEST_MODES), "illegal verification_mode"),
        (absent("finalized_at"), "missing finalized_at"), (~absent("finalized_at") & ~(form & F.when(form, date).try_cast("date").isNotNull()), "finalized_at is no date"),
        (absent("claims") & absent("mapping"), "neither mapping nor claims"),
        (~absent("claims") & _array(m["claims"]).isNull(), "claims must be an array"), (~absent("mapping") & _array(m["mapping"]).isNull(), "mapping must be an array"),
    ]), F.when(review.isNull() | F.is_variant_null(review), F.array().cast(_PROBLEMS)).otherwise(_found(F.lit("review_independence"), [
        (r.isNull(), "must be an object"), *[(typed(x, "STRING"), f"{x} must be a string") for x in ("reviewer_model", "writer_model", "model_family")],
        *[(typed(x, "BOOLEAN"), f"{x} must be a boolean") for x in ("context_shared", "evidence_shared")], (r.isNotNull() & _bad(r["human_involvement"], ("none", "partial", "full")), "illegal human_involvement"),
    ])))


def _mapping_problems(m: Column, path: Column, again: Column) -> Column:
    url, ok = _text(m["url"]), m.isNotNull()
    form = lambda key, pattern: (ok & ~_text(m[key]).rlike(pattern), f"{key} format")
    return _found(path, [
        (~ok, "must be an object"), *[(ok & m[x].isNull(), f"missing {x}") for x in ("citation", "mapped", "source_id")],
        form("source_id", r"^S\d+$"), form("citation", r"^\[S\d+\]$"), form("mapped", r"^\[\d+\]$"), (ok & (url != "") & ~url.rlike("^(https?|file)://"), "url scheme"), (again, "duplicate source_id"),
    ])


def _claim_problems(m: Column, path: Column, again: Column) -> Column:
    ok = m.isNotNull()
    return _found(path, [
        (~ok, "must be an object"), *[(ok & m[x].isNull(), f"missing {x}") for x in ("claim_id", "claim_class", "claim_text", "evidence")],
        (ok & ~_text(m["claim_id"]).rlike(r"^C-\d+$"), "claim_id format"),
        *[(ok & _bad(m[x], values), f"illegal {x}") for x, values in (("claim_class", k.CLAIM_CLASSES), ("risk", k.RISKS), ("evidence_status", EVIDENCE_STATUSES), ("confidence", k.CONFIDENCES))],
        (ok & m["evidence"].isNotNull() & _array(m["evidence"]).isNull(), "evidence must be an array"),
        (ok & m["interpretation"].isNotNull() & (_kind(m["interpretation"]) != "STRING"), "interpretation must be a string"), (again, "duplicate claim_id"),
    ])


def _evidence_problems(m: Column, l: Column, path: Column) -> Column:
    ok, place = m.isNotNull(), l.isNotNull()
    whole = lambda x: place & l[x].isNotNull() & ~_kind(l[x]).isin("BIGINT", "BOOLEAN")
    return _found(path, [
        (~ok, "must be an object"), *[(ok & m[x].isNull(), f"missing {x}") for x in ("source_id", "support_level")], (ok & ~_text(m["source_id"]).rlike(r"^S\d+$"), "source_id format"),
        *[(ok & _bad(m[x], values), f"illegal {x}") for x, values in (("support_level", k.SUPPORT_LEVELS), ("authority", k.AUTHORITIES), ("freshness", k.FRESHNESS), ("relation", k.RELATIONS))],
        (ok & ~place & m["locator"].isNotNull() & ~F.is_variant_null(m["locator"]), "locator must be an object"),
        (place & (F.size(F.array_except(F.map_keys(l), F.array(*[F.lit(x) for x in k.LOCATOR_KEYS]))) > 0), "locator has an unknown key"),
        (place & l["locator_quality"].isNotNull() & ~_text(l["locator_quality"]).isin(*k.LOCATOR_QUALITIES), "illegal locator_quality"),
        (whole("page"), "locator.page must be an integer"), (whole("paragraph"), "locator.paragraph must be an integer"),
    ])


def contract_problems(manifests: DataFrame) -> DataFrame:
    """(doc_id, path, problem) of manifests (doc_id, json). Types and absent keys are seen in the VARIANT, where a typed reader would give null.

    A legacy version is no problem; `warnings` names it. Each manifest is parsed once; its root, mappings and claims become rows, and a claim's
    evidence is judged within its row: nothing is shuffled or kept.
    """
    d = manifests.select("doc_id", _object(F.try_parse_json("json")).alias("root"))

    def members(name: str, key: str) -> Column:
        items = F.transform(_array(F.col("root")[name]), lambda v: _object(v))
        ids = F.transform(items, lambda m: F.when(m.isNotNull(), _text(m[key])))
        # An item whose id an earlier one has; what isn't an object has no id.
        pairs = F.transform(F.arrays_zip(items.alias("m"), ids.alias("id"), F.transform(ids, lambda x, i: F.array_position(ids, x) <= i).alias("again")), lambda x, i: F.struct(F.lit(name).alias("level"), i.alias("i"), x["m"].alias("m"), F.coalesce(x["again"], F.lit(False)).alias("again")))
        return F.coalesce(pairs, F.array().cast(_ITEMS))

    root = F.array(F.struct(F.lit("root").alias("level"), F.lit(-1).alias("i"), F.col("root").alias("m"), F.lit(False).alias("again")))
    rows = d.select("doc_id", F.explode(F.concat(root, members("mapping", "source_id"), members("claims", "claim_id"))).alias("x")).select("doc_id", "x.*")
    m, again, path = F.col("m"), F.col("again"), _place("claims", F.col("i"))
    edges = F.transform(F.transform(_array(m["evidence"]), lambda e: _object(e)), lambda e, j: _evidence_problems(e, _object(e["locator"]), _place("evidence", j, path)))
    problems = (
        F.when(F.col("level") == "mapping", _mapping_problems(m, _place("mapping", F.col("i")), again))
        .when(F.col("level") == "claims", F.concat(_claim_problems(m, path, again), F.coalesce(F.flatten(edges), F.array().cast(_PROBLEMS))))
        .when(m.isNull(), F.array(F.struct(F.lit("").alias("path"), F.lit("root must be an object").alias("problem")))).otherwise(_root_problems(m))
    )
    return rows.select("doc_id", F.explode(problems).alias("p")).select("doc_id", "p.*")


_PROBLEMS = "array<struct<path:string,problem:string>>"
_ITEMS = "array<struct<level:string,i:int,m:map<string,variant>,again:boolean>>"


def warnings(manifests: DataFrame) -> DataFrame:
    """Legacy versions: (doc_id, version)."""
    version = F.get_json_object("json", "$.schema_version")
    return manifests.where(version.isin(*LEGACY_VERSIONS)).select("doc_id", version.alias("version"))


def _with_member(members: Column, name: str, value: Column) -> Column:
    """An object's members with one more, or another in its place; `value` is JSON."""
    return F.map_concat(F.map_filter(members, lambda k_, _: k_ != name), F.create_map(F.lit(name), F.try_parse_json(value)))


def _mapped(v: Column, change: Callable[[Column], Column]) -> Column:
    """The JSON of a list with its objects changed; whatever else it holds stays."""
    each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(change(x), F.to_json(x)))
    return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))


def _edge(v: Column) -> Column:
    """An edge as JSON with a relation: its own, or what its level says."""
    m = _object(v)
    relation = F.concat(F.lit('"'), relation_of(F.coalesce(F.try_variant_get(m["support_level"], "$", "string"), F.lit(""))), F.lit('"'))
    return F.when(m.isNotNull(), F.to_json(F.when(F.map_contains_key(m, "relation"), m).otherwise(_with_member(m, "relation", relation))))


def _claim(v: Column) -> Column:
    m = _object(v)
    evidence = m["evidence"]
    return F.when(F.try_variant_get(evidence, "$", "array<variant>").isNotNull(), F.to_json(_with_member(m, "evidence", _mapped(evidence, _edge))))


def migrated(text: str | Column) -> Column:
    """Manifests at the current version, unknown fields at every level included; null if the version can't be migrated.

    A text of the current version stays as it is. The tree is rewritten as VARIANT within its row; numbers keep their value, not their spelling, and objects come with their keys in order.
    """
    text = F.col(text) if isinstance(text, str) else text
    m = _object(F.try_parse_json(text))
    version = F.try_variant_get(m["schema_version"], "$", "string")
    target = lookup(version, LEGACY_VERSIONS, None)
    out = _with_member(m, "schema_version", F.concat(F.lit('"'), target, F.lit('"')))
    independence = F.lit('{"human_involvement":"none","context_shared":true,"evidence_shared":true}')
    out = F.when(F.map_contains_key(m, "review_independence"), out).otherwise(_with_member(out, "review_independence", independence))
    claims = m["claims"]
    out = F.when(F.try_variant_get(claims, "$", "array<variant>").isNotNull(), _with_member(out, "claims", _mapped(claims, _claim))).otherwise(out)
    return F.when(version == SCHEMA_VERSION, text).when(target.isNotNull(), F.to_json(out))


def migration_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges whose relation a migration added, by claim and place."""

    def edges(d: DataFrame) -> DataFrame:
        c = d.select("doc_id", F.posexplode(F.from_json("json", MANIFEST)["claims"]).alias("i", "c"))
        return c.select("doc_id", "i", F.posexplode("c.evidence").alias("j", "e")).select("doc_id", "i", "j", "e.source_id", "e.relation")

    old = edges(before).withColumnRenamed("relation", "was")
    return edges(after).join(old, ["doc_id", "i", "j", "source_id"]).where(~F.col("relation").eqNullSafe(F.col("was")))


def verdicts(reviews: DataFrame) -> DataFrame:
    """`reviews` (file, text) with stage and verdict; files without a verdict are left out."""
    stem = F.regexp_replace("file", r"\.md$", "")
    stage = stem
    for begin, label in reversed(STAGES.items()):
        stage = F.when(stem.startswith(begin), label).otherwise(stage)
    d = reviews.withColumns({"stage": stage, "verdict": F.trim(F.regexp_extract("text", r"\*\*判决\*\*\s*[:：]\s*(.+)", 1))})
    return d.where(F.col("verdict") != "")


# What a bundle's reports say of themselves.
SOURCE_MAP_NOTE = "正文 [n] 引文 → source_id 的审计对账表（由 evidence_manifest.mapping 聚合）"
REVIEW_NOTE = "同模型自审（ai-internal）≠ 独立评审；跨模型（ai-cross-model）若共享上下文/证据也非独立。R4/投稿/安全关键须 human-expert"
REPORTS = ("claims", "evidence", "source-map", "review")


def bundles(claims: DataFrame, edges: DataFrame, source_map: DataFrame, reviews: DataFrame, finalized_at: str, review_kind: str = "ai-internal", mode: str = "static") -> tuple[DataFrame, DataFrame]:
    """G14, SK8: reports (case_key, report, json) of each case whose claim and source manifests keep the contract, and problems (case_key, manifest, path, problem) of all others.

    `source_map` (case_key, manifest) has the source manifests, `reviews` (case_key, file, text) the reviews' files. A case is one that has claims or a source manifest: without claims its
    claim manifest is empty, without a source manifest it fails. One case's problems leave the others alone.
    """
    own = claim_manifests(claims, edges, finalized_at, review_kind, mode).select("case_key", F.col("manifest").alias("claims"))
    head = [F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(review_kind).alias("review_kind"), F.lit(mode).alias("verification_mode"), F.lit(finalized_at).alias("finalized_at")]
    empty = F.to_json(F.struct(*head, F.array().cast(T.ArrayType(CLAIM)).alias("claims")))
    d = own.join(source_map.select("case_key", F.col("manifest").alias("evidence")), "case_key", "full").withColumn("claims", F.coalesce("claims", empty))
    found = None
    for name in ("claims", "evidence"):
        p = contract_problems(d.where(F.col(name).isNotNull()).select(F.col("case_key").alias("doc_id"), F.col(name).alias("json"))).select(F.col("doc_id").alias("case_key"), F.lit(name).alias("manifest"), "path", "problem")
        found = p if found is None else found.unionByName(p)
    found = found.unionByName(d.where(F.col("evidence").isNull()).select("case_key", F.lit("evidence").alias("manifest"), F.lit("").alias("path"), F.lit("no source manifest").alias("problem")))
    good = d.join(found.select("case_key").distinct(), "case_key", "left_anti")
    stages = verdicts(reviews).groupBy("case_key").agg(F.array_sort(F.collect_list(F.struct("file", "stage", "verdict"))).alias("stages"))
    good = good.join(stages, "case_key", "left").withColumn("stages", F.coalesce("stages", F.array().cast(stages.schema["stages"].dataType)))
    mapping = F.try_variant_get(F.try_parse_json("evidence"), "$.mapping", "variant")
    maps = F.to_json(F.struct(head[0], head[3], F.lit(SOURCE_MAP_NOTE).alias("note"), mapping.alias("mapping")))
    review = F.to_json(F.struct(*head, F.lit(REVIEW_NOTE).alias("note"), "stages"))
    reports = F.array(*[F.struct(F.lit(name).alias("report"), x.alias("json")) for name, x in zip(REPORTS, (F.col("claims"), F.col("evidence"), maps, review), strict=True)])
    return good.select("case_key", F.explode(reports).alias("r")).select("case_key", "r.*"), found


def title_of(prefer_long: bool) -> Column:
    """Which of two title fields comes first differs between the finisher and the corpus check."""
    return filled(F.col("title_or_name"), F.col("title")) if prefer_long else filled(F.col("title"), F.col("title_or_name"))
