"""RU1 to RU4 and L3 over many cases: rule layers are data, merged in one plan.

Each case has layers, JSON objects in order: defaults, a user's file, a file of its own; then the scenario profile that it names, which the merged layers hold. Cases with the same layers and
profile share a rule set, so that merging grows with the number of different rule sets, not of cases.

Layers are taken apart to the paths of their values, level by level until no object is left. A value counts if no later layer mentions its path, and no later layer has
something other than an object on the way to it: objects merge, all else is replaced, lists as wholes. An object over a value drops the value, a null is a value. Whatever is left is joined to claims, sources and drafts
as tables by rule set, or built into trees again.

Cases that can't be resolved have a problem row and no rules: a layer that is no JSON object, a layer number that comes twice, a profile that their layers don't hold.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import contracts as k
from attesta.sources.checkpoints import settled

#: Where the merged layers keep their profiles, and the key that names the one in force.
PROFILES, ACTIVE = "scenario_profiles", "active_profile"
_PATH = "array<string>"


def _children(v: Column) -> Column:
    """The members of an object, null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def nodes(docs: DataFrame) -> DataFrame:
    """(set_key, layer, path, value) of documents (set_key, layer, v variant): each value as JSON, null for an object."""
    found, here = None, docs.select("set_key", "layer", F.array().cast(_PATH).alias("path"), "v")
    while True:
        d = settled(here.withColumn("m", _children(F.col("v"))))
        if d.isEmpty():
            return settled(found if found is not None else d.select("set_key", "layer", "path", F.lit(None).cast("string").alias("value")))
        level = d.select("set_key", "layer", "path", F.when(F.col("m").isNull(), F.to_json("v")).alias("value"))
        found = level if found is None else found.unionByName(level)
        here = d.where(F.size("m") > 0).select("set_key", "layer", "path", F.explode("m").alias("key", "v")).select("set_key", "layer", F.concat("path", F.array("key")).alias("path"), "v")


def merged(found: DataFrame) -> DataFrame:
    """RU1: (set_key, path, value) of what the layers make together; an object is there only if nothing lies within it."""
    last = settled(found.groupBy("set_key", "path").agg(F.max("layer").alias("last"), F.max_by("value", F.col("layer")).alias("value"), F.max(F.when(F.col("value").isNotNull(), F.col("layer"))).alias("cut")))
    # What lies under a path that a layer cut counts from that layer on. Paths are short: each asks for all its ancestors.
    asked = last.select("set_key", "path", "last", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("above")).where(F.size("above") < F.size("path"))
    cuts = last.where(F.col("cut").isNotNull()).select("set_key", F.col("path").alias("above"), "cut")
    dead = asked.join(cuts, ["set_key", "above"]).where(F.col("cut") > F.col("last")).select("set_key", "path").distinct()
    alive = last.join(dead, ["set_key", "path"], "left_anti")
    inner = alive.where(F.size("path") > 0).select("set_key", F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))).alias("path")).distinct()
    objects = alive.where(F.col("value").isNull()).join(inner, ["set_key", "path"], "left_anti").select("set_key", "path", F.lit("{}").alias("value"))
    return alive.where(F.col("value").isNotNull()).select("set_key", "path", "value").unionByName(objects)


def resolve(layers: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """RU2: rules (set_key, path, value), members (case_key, set_key) and problems (case_key, problem).

    `layers` (case_key, layer, doc) and `cases` (case_key, profile); a blank profile is none. A case without layers has no rules but no problem either.
    """
    profile = F.nullif(F.trim(F.coalesce("profile", F.lit(""))), F.lit(""))
    lists = layers.groupBy("case_key").agg(F.array_sort(F.collect_list(F.struct("layer", "doc"))).alias("docs"))
    d = cases.select("case_key", profile.alias("profile")).join(lists, "case_key", "left").withColumn("docs", F.coalesce("docs", F.array().cast(lists.schema["docs"].dataType)))
    unread = F.exists("docs", lambda x: x["layer"].isNull() | _children(F.try_parse_json(x["doc"])).isNull())
    twice = F.size(F.array_distinct(F.transform("docs", lambda x: x["layer"]))) < F.size("docs")
    d = d.withColumns({"set_key": F.sha2(F.to_json(F.struct("docs", "profile")), 256), "problem": F.when(unread, "layer is no JSON object").when(twice, "layer given twice")})
    d = settled(d)
    sets = d.where(F.col("problem").isNull()).groupBy("set_key").agg(F.first("docs").alias("docs"), F.first("profile").alias("profile"))
    docs = sets.select("set_key", F.explode("docs").alias("d")).select("set_key", F.col("d.layer").cast("long").alias("layer"), F.try_parse_json("d.doc").alias("v"))
    base = nodes(docs)
    plain = settled(merged(base))
    # The profile's own subtree is one more layer, after all others.
    own = plain.join(sets.where(F.col("profile").isNotNull()).select("set_key", "profile"), "set_key")
    own = own.where((F.get("path", F.lit(0)) == PROFILES) & (F.get("path", F.lit(1)) == F.col("profile")) & ((F.size("path") > 2) | (F.col("value") == "{}")))
    top = F.lit(1 << 62)
    values = own.select("set_key", top.alias("layer"), F.slice("path", F.lit(3), F.size("path")).alias("path"), F.nullif("value", F.lit("{}")).alias("value"))
    # Objects on the way, so that an object of the profile drops a value under the same path.
    inner = values.select("set_key", "layer", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("above"), F.size("path").alias("n")).where(F.size("above") < F.col("n"))
    known = values.select("set_key").distinct()
    named = sets.join(known, "set_key").select("set_key", top.alias("layer"), F.array(F.lit(ACTIVE)).alias("path"), F.to_json(F.to_variant_object(F.array("profile"))).alias("value"))
    named = named.withColumn("value", F.substring("value", F.lit(2), F.length("value") - 2))
    unknown = sets.where(F.col("profile").isNotNull()).join(known, "set_key", "left_anti")
    rows = base.unionByName(values).unionByName(inner.select("set_key", "layer", F.col("above").alias("path"), F.lit(None).cast("string").alias("value")).distinct()).unionByName(named)
    rules = settled(merged(rows.join(unknown.select("set_key"), "set_key", "left_anti")))
    choices = plain.where((F.get("path", F.lit(0)) == PROFILES) & (F.size("path") > 1)).groupBy("set_key").agg(F.array_join(F.array_sort(F.collect_set(F.get("path", F.lit(1)))), ", ").alias("choices"))
    missing = unknown.join(choices, "set_key", "left").select("set_key", F.concat(F.lit("unknown profile "), "profile", F.lit("; available: "), F.coalesce("choices", F.lit(""))).alias("missing"))
    d = d.join(missing, "set_key", "left").withColumn("problem", F.coalesce("problem", "missing"))
    return rules, d.where(F.col("problem").isNull()).select("case_key", "set_key"), d.where(F.col("problem").isNotNull()).select("case_key", "problem")


def trees(rules: DataFrame) -> DataFrame:
    """(set_key, rules): the merged layers as one JSON object, keys in order. Built from the deepest level up."""
    depth = rules.agg(F.max(F.size("path"))).first()[0]
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("k"))), r'^\{"k":(.*)\}$', 1)
    for n in range(depth or 0, 0, -1):
        deep = rules.where(F.size("path") == n).withColumn("key", F.element_at("path", -1))
        entry = F.struct("key", F.concat(quoted(F.col("key")), F.lit(":"), "value").alias("t"))
        up = deep.groupBy("set_key", F.slice("path", F.lit(1), F.lit(n - 1)).alias("path")).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), ","), F.lit("}")).alias("value"))
        rules = rules.where(F.size("path") < n).unionByName(up)
    return rules.select("set_key", F.col("value").alias("rules"))


def _at(rules: DataFrame, *path: str) -> DataFrame:
    """The rules under a path; its stars stand for any key and are given as k0, k1, ..."""
    d, n = rules, 0
    for i, x in enumerate(path):
        key = F.get("path", F.lit(i))
        if x == "*":
            d, n = d.withColumn(f"k{n}", key), n + 1
        else:
            d = d.where(key == x)
    return d.where(F.size("path") >= len(path)).withColumn("rest", F.slice("path", F.lit(len(path) + 1), F.size("path")))


def text(value: Column) -> Column:
    """A JSON value as a string, a string without its quotes, null for null."""
    return F.try_variant_get(F.try_parse_json(value), "$", "string")


def table(rules: DataFrame, path: tuple[str, ...], fields: dict[str, str]) -> DataFrame:
    """One row for each key at the path's stars, with the named fields below it in their types."""
    d = _at(rules, *path).where(F.size("rest") == 1)
    keys = ["set_key", *(f"k{i}" for i in range(sum(x == "*" for x in path)))]
    field = lambda name, kind: F.max(F.when(F.get("rest", F.lit(0)) == name, text(F.col("value")))).try_cast(kind).alias(name)
    return d.groupBy(*keys).agg(*[field(name, kind) for name, kind in fields.items()])


def tiers(rules: DataFrame) -> DataFrame:
    """(set_key, risk, primary, independent, live, coverage): evidence that each risk asks for."""
    d = table(rules, ("evidence_sufficiency", "*"), {"min_primary_sources": "int", "min_independent_sources": "int", "live": "boolean", "contradiction_coverage": "boolean"})
    whole = lambda x, other: F.coalesce(F.col(x), F.lit(other))
    return d.select("set_key", F.col("k0").alias("risk"), whole("min_primary_sources", 0).alias("primary"), whole("min_independent_sources", 0).alias("independent"), whole("live", False).alias("live"), whole("contradiction_coverage", False).alias("coverage"))


def floors(rules: DataFrame) -> DataFrame:
    """(set_key, risk, floor): L3, the least authority of sources for each risk; a risk without one has no row."""
    d = table(rules, ("risk_tiers", "*"), {"authority_min": "string"})
    return d.where(F.col("authority_min").isin(*k.AUTHORITIES)).select("set_key", F.col("k0").alias("risk"), F.col("authority_min").alias("floor"))


def minimums(rules: DataFrame) -> DataFrame:
    """RU4: (set_key, doc_type, min_sources, min_chars)."""
    return table(rules, ("doc_minimums", "*"), {"min_sources": "int", "min_chars": "int"}).withColumnRenamed("k0", "doc_type")


def suspect_domains(rules: DataFrame, members: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """RU3: (set_key, domains): base, scenario and own domains in that order, each once. With `members` and `extra` (case_key, domains) by case instead."""
    lists = lambda name: F.max(F.when(F.get("path", F.lit(0)) == name, F.col("value"))).alias(name)
    d = rules.where(F.size("path") == 1).groupBy("set_key").agg(lists("suspect_domains"), lists("suspect_domains_extra"))
    strings = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "array<string>"), F.array().cast(_PATH))
    d = d.select("set_key", F.concat(strings(F.col("suspect_domains")), strings(F.col("suspect_domains_extra"))).alias("domains"))
    if members is None:
        return d.withColumn("domains", F.array_distinct("domains"))
    d = members.join(d, "set_key", "left").join(extra.select("case_key", F.col("domains").alias("own")), "case_key", "left")
    none = F.array().cast(_PATH)
    return d.select("case_key", F.array_distinct(F.concat(F.coalesce("domains", none), F.coalesce("own", none))).alias("domains"))


def ranking(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """SC8: registry rows (id, category, ...) with authority, priority and role by a ranking file (doc, JSON): the category's, over which the source's own fields go."""
    fields = {"authority": "string", "priority": "double", "role": "string"}
    found = merged(nodes(docs.select(F.lit("r").alias("set_key"), F.lit(0).cast("long").alias("layer"), F.try_parse_json("doc").alias("v"))))
    own = lambda at, key: table(found, (at, "*"), fields).select(F.col("k0").alias(key), F.struct(*fields).alias(at))
    d = registry.join(F.broadcast(own("default_by_category", "category")), "category", "left").join(F.broadcast(own("sources", "id")), "id", "left")
    first = lambda x: F.coalesce(F.col(f"sources.{x}"), F.col(f"default_by_category.{x}"))
    priority = F.coalesce(F.nullif(F.floor(first("priority")), F.lit(0)), F.lit(k.DEFAULT_PRIORITY)).cast("int")
    role = F.coalesce(F.try_variant_get(F.try_parse_json(first("role")), "$", "array<string>"), F.array().cast(_PATH))
    return d.select(*registry.columns, F.coalesce(first("authority"), F.lit("")).alias("authority"), priority.alias("priority"), role.alias("role"))


def below_floor(claims: DataFrame, sources: DataFrame, evidence: DataFrame, members: DataFrame, by_set: DataFrame) -> DataFrame:
    """L3, L4 with each case's own floors: support edges from sources of less authority than the claim's case asks for, or superseded ones of high risk."""
    from attesta.functions.evidence import lookup
    from attesta.operators.claims import edges_with_sources

    rank = {a: i for i, a in enumerate(k.AUTHORITIES)}
    asked = claims.join(members, "case_key", "left").join(by_set, ["set_key", "risk"], "left").select("claim_key", "risk", "claim_class", "floor")
    e = edges_with_sources(evidence.where(F.col("relation") != "contradicts"), sources).join(asked, "claim_key")
    risky = F.col("risk").isin("R3", "R4")
    low = F.coalesce(lookup(F.col("authority"), rank, len(rank)) > lookup(F.col("floor"), rank, None), F.lit(False))
    return e.withColumns({"below": low, "superseded": risky & (F.col("freshness") == "superseded"), "stale": risky & (F.col("claim_class") == "N") & (F.col("freshness") != "current")}).where("below OR superseded OR stale")


def sufficiency_needs(claims: DataFrame, members: DataFrame, by_set: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """J2 with each case's own tiers: claims with need_primary and need_independent (rounded up), need_live and need_coverage; a risk without a tier has the default."""
    names = dict(zip(("primary", "independent", "live", "coverage"), k.DEFAULT_TIER, strict=True))
    d = claims.join(members, "case_key", "left").join(by_set, ["set_key", "risk"], "left").withColumns({x: F.coalesce(x, F.lit(v)) for x, v in names.items()})
    up = lambda x: F.ceil(F.col(x) * multiplier).cast("int").alias(f"need_{x}")
    return d.select(*claims.columns, up("primary"), up("independent"), F.col("live").alias("need_live"), F.col("coverage").alias("need_coverage"))


def default_layer() -> str:
    """The built-in rules as the first layer of a case."""
    from attesta.plans.rules import DEFAULTS

    return json.dumps(DEFAULTS, ensure_ascii=False)
