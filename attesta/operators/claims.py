"""Claims against their evidence: sufficiency, score, auditability, balance and risk rules.

`claims`, `sources` and `evidence` are the model's tables: one row for each claim (claim_key), source
(source_key) and edge. Any number of cases is checked at once: edges are joined to sources, which broadcast if they are
small, and are aggregated once by claim.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta import contracts as k
from attesta.functions.evidence import balance_of, blank, given_place, grade_of, id_of, is_primary, located, lookup


def edges_with_sources(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Every edge with what is known of its source; a missing source leaves blanks."""
    known = sources.select("source_key", "authority", "freshness", "url", F.lit(True).alias("known"))
    return evidence.join(known, "source_key", "left").withColumns({x: F.coalesce(x, F.lit("")) for x in ("authority", "freshness", "url")}).withColumn("known", F.coalesce("known", F.lit(False)))


def claim_statistics(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts and sums of tenths by claim. One shuffle of the edges; claims without edges stay.

    F21: only keys that are source ids count as independent or primary sources; the score knows all edges.
    """
    support, source = F.col("relation") != "contradicts", id_of(edges).startswith("S")
    primary, placed = source & is_primary(F.col("authority")), given_place(edges)
    tenths = lambda c, t, other: F.sum(F.when(support, lookup(F.col(c), t, other)).otherwise(0))
    sums = edges.groupBy("claim_key").agg(
        F.count_if(source).alias("independent"),
        F.count_if(primary).alias("primary_sources"),
        F.coalesce(F.bool_or(primary & (F.col("freshness") == "current")), F.lit(False)).alias("current_primary"),
        F.count_if(support).alias("n_support"),
        F.count_if(F.col("relation") == "contradicts").alias("n_against"),
        F.count_if(F.col("relation") == "context_only").alias("n_context"),
        tenths("authority", k.AUTHORITY_TENTHS, k.OTHER_AUTHORITY).alias("t_authority"),
        tenths("support_level", k.LEVEL_TENTHS, k.OTHER_LEVEL).alias("t_level"),
        tenths("freshness", k.FRESHNESS_TENTHS, k.OTHER_FRESHNESS).alias("t_freshness"),
        F.count_if(support & (placed | ~blank(F.col("url")))).alias("n_traceable"),
        F.count_if(support & placed).alias("n_located"),
        F.count_if(support & ~placed).alias("n_unlocated"),
    )
    numbers = [c for c in sums.columns if c not in ("claim_key", "current_primary")]
    out = claims.join(sums, "claim_key", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in numbers}).withColumn("current_primary", F.coalesce("current_primary", F.lit(False)))


def score_of() -> Column:
    """A7 over the columns of `claim_statistics`, in whole tenths: halves go to the even tenth, as in correct rounding."""
    n = F.greatest(F.col("n_support"), F.lit(1))
    reproducible = F.least(F.lit(50), F.when(F.col("claim_class").isin("C", "M"), 30).otherwise(50) + F.when(F.col("n_located") > 0, 20).otherwise(0))
    fixed = F.when(F.col("n_support") > 1, 150).otherwise(75) + F.when(F.col("covered"), 100).otherwise(0) + reproducible
    total = 25 * F.col("t_authority") + 20 * F.col("t_level") + 10 * F.col("t_freshness") + 150 * F.col("n_traceable") + fixed * n
    whole = F.floor(total / n).cast("long")
    rest = 2 * (total - whole * n)
    tenths = whole + F.when((rest > n) | ((rest == n) & (whole % 2 == 1)), 1).otherwise(0)
    return F.when(F.col("n_support") > 0, tenths.cast("double") / 10).otherwise(0.0)


_TOTAL = """(25 * t_authority + 20 * t_level + 10 * t_freshness + 150 * n_traceable + n_support * (CASE WHEN n_support > 1 THEN 150 ELSE 75 END + CASE WHEN covered THEN 100 ELSE 0 END
    + least(50, CASE WHEN claim_class IN ('C', 'M') THEN 30 ELSE 50 END + CASE WHEN n_located > 0 THEN 20 ELSE 0 END)))::BIGINT"""
SCORE_SQL = f"""CASE WHEN n_support > 0 THEN ({_TOTAL} // n_support + CASE WHEN 2 * ({_TOTAL} % n_support) > n_support OR (2 * ({_TOTAL} % n_support) = n_support AND ({_TOTAL} // n_support) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 10 ELSE 0.0::DOUBLE END"""
GRADE_SQL = "CASE WHEN score >= 90 THEN 'Strong' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Moderate' WHEN score >= 40 THEN 'Weak' ELSE 'Insufficient' END"


def tier_value(i: int) -> Column:
    """A threshold of the claim's tier; an unknown risk has the default."""
    return lookup(F.col("risk"), {r: t[i] for r, t in k.TIERS.items()}, k.DEFAULT_TIER[i])


def needed(i: int, multiplier: float) -> Column:
    return lookup(F.col("risk"), {r: math.ceil(t[i] * multiplier) for r, t in k.TIERS.items()}, math.ceil(k.DEFAULT_TIER[i] * multiplier))


def sufficiency(claims: DataFrame, sources: DataFrame, evidence: DataFrame, mode: str = "balanced") -> DataFrame:
    """Verdict, reasons in order, score and grade of every claim."""
    multiplier, live_for_all = k.REVIEW_MODES[mode]
    d = claim_statistics(claims, edges_with_sources(evidence, sources))
    live = F.lit(True) if live_for_all else tier_value(2)
    reasons = F.array_compact(F.array(
        F.when(F.col("primary_sources") < needed(0, multiplier), "primary"),
        F.when(F.col("independent") < needed(1, multiplier), "independent"),
        F.when(live & (F.col("claim_class") == "N") & ~F.col("current_primary"), "current"),
        F.when(live & (F.col("claim_class") != "N") & (F.lower("verification_mode") != "live"), "live"),
        F.when(tier_value(3) & ~F.col("covered"), "coverage"),
    ))
    d = d.withColumns({"reasons": F.array_join(reasons, ","), "score": score_of()})
    return d.withColumns({"passed": F.col("reasons") == "", "grade": grade_of(F.col("score"))})


def claims_by_source(evidence: DataFrame) -> DataFrame:
    """(source_id, n, claims: array of {claim_key, support_level, relation} in order of their keys)."""
    e = evidence.select(id_of(evidence).alias("source_id"), "claim_key", "support_level", "relation")
    return e.groupBy("source_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("claim_key", "support_level", "relation"))).alias("claims"))


def changed_only(claims: DataFrame, changed: DataFrame) -> DataFrame:
    """the claims whose id is in `changed`; ids that aren't claim ids count for nothing."""
    return claims.join(changed.where(F.col("claim_id").startswith("C-")).select("claim_id").distinct(), "claim_id", "left_semi")


def recheck(claims: DataFrame, sources: DataFrame, evidence: DataFrame, changed: DataFrame, mode: str = "balanced") -> DataFrame:
    """sufficiency of the changed claims; the edges of others are left out before they are joined to sources and aggregated."""
    some = changed_only(claims, changed)
    return sufficiency(some, sources, evidence.join(some.select("claim_key"), "claim_key", "left_semi"), mode)


def balance(claims: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """How a claim's edges stand to each other."""
    d = claim_statistics(claims, edges_with_sources(evidence, sources))
    # Edges that neither contradict nor give context only are support, whatever else their level says.
    support = F.col("n_support") - F.col("n_context")
    return d.withColumn("mark", balance_of(support, F.col("n_against"), F.col("n_context")))


def high_risk() -> Column:
    return F.col("risk").isin("R3", "R4") | (F.col("claim_class") == "N")


def auditability(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """By claim, the support edges and those without a place in their source."""
    support = evidence.where(F.col("relation") != "contradicts").groupBy("claim_key").agg(
        F.count("*").alias("n_support"), F.sort_array(F.collect_list(F.when(~located(evidence), F.col("source_key")))).alias("lost")
    )
    d = claims.join(support, "claim_key", "left").withColumns({"n_support": F.coalesce("n_support", F.lit(0)), "lost": F.coalesce("lost", F.array().cast(T.ArrayType(evidence.schema["source_key"].dataType)))})
    return d.withColumns({"high_risk": high_risk(), "n_lost": F.size("lost"), "auditable": F.size("lost") == 0})


def audit_summary(audited: DataFrame) -> DataFrame:
    """G9 over all claims: shares of support edges and of claims with a place, and whether the gate passes."""
    s = audited.agg(
        F.count("*").alias("claims"), F.coalesce(F.sum("n_support"), F.lit(0)).alias("edges"), F.coalesce(F.sum("n_lost"), F.lit(0)).cast("long").alias("lost"),
        F.count_if("high_risk").alias("high_risk"), F.count_if(F.col("high_risk") & ~F.col("auditable")).alias("high_risk_failing"),
    )
    ratio = F.when(F.col("edges") > 0, F.bround((F.col("edges") - F.col("lost")) / F.col("edges"), 3)).otherwise(1.0)
    return s.withColumns({"ratio": ratio, "passed": F.col("high_risk_failing") == 0})


def unsupported_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """L1: claims of a class that needs a source and that have no edge."""
    return claims.where(F.col("claim_class").isin(*k.NEEDS_SOURCE)).join(evidence, "claim_key", "left_anti")


def derived_status(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """L2: what the distribution of support levels makes of a claim."""
    n = lambda *levels: F.count_if(F.col("support_level").isin(*levels))
    counts = evidence.groupBy("claim_key").agg(n("direct").alias("direct"), n("strong_inference", "weak_inference").alias("inferred"), n("contradictory").alias("against"))
    d = claims.join(counts, "claim_key", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("direct", "inferred", "against")})
    some = F.col("direct") + F.col("inferred")
    status = (
        F.when((some == 0) & (F.col("against") == 0), "unsupported").when(F.col("against") > some, "contradicted")
        .when((F.col("direct") > 0) & (F.col("against") == 0), "supported").otherwise("partially_supported")
    )
    return d.withColumn("status", status)


STATUS_SQL = "CASE WHEN direct + inferred = 0 AND against = 0 THEN 'unsupported' WHEN against > direct + inferred THEN 'contradicted' WHEN direct > 0 AND against = 0 THEN 'supported' ELSE 'partially_supported' END"


def below_floor(claims: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """L3, L4: support edges of high-risk claims from sources of too little authority, or superseded."""
    rank = {a: i for i, a in enumerate(k.AUTHORITIES)}
    e = edges_with_sources(evidence.where(F.col("relation") != "contradicts"), sources).join(claims.select("claim_key", "risk", "claim_class"), "claim_key")
    floor = lookup(F.col("risk"), {r: rank[a] for r, a in k.AUTHORITY_FLOOR.items()}, 99)
    low = lookup(F.col("authority"), rank, 98) > floor
    risky = F.col("risk").isin("R3", "R4")
    return e.withColumns({"below": low, "superseded": risky & (F.col("freshness") == "superseded"), "stale": risky & (F.col("claim_class") == "N") & (F.col("freshness") != "current")}).where("below OR superseded OR stale")

