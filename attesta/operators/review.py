"""Rules of search and review: when to stop searching, whether coverage and review chapter suffice, whether gaps let a draft in, what a source may be used for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.citations import refs_boundary_last
from attesta.operators.documents import chapters
from attesta.sources.checkpoints import stored

# Key problems and key technologies that every case answers; least idle sources in a row, least sources of a core claim; least share of the review chapter.
TARGETS = ("P1", "P2", "P3", "T1", "T2", "T3")
IDLE_RUN, CORE_SOURCES, REVIEW_SHARE = 5, 2, 0.4
REVIEW_CHAPTER = "综述|研究现状|文献回顾"
SOURCE_MARK = r"\[S(\d+)\](?!\()"


def news(arrivals: DataFrame, edges: DataFrame) -> DataFrame:
    """`arrivals` (case_key, place, source_key, ...) with new_claims, new_contradictions, idle and run: idle sources in a row so far.

    A claim is new with the first source that has an edge to it, a contradiction with the first that contradicts its claim. Sets of what was seen
    are least places, aggregated by claim; only the run is a window over the case's arrivals.
    """
    e = edges.join(arrivals.select("case_key", "source_key", "place"), ["case_key", "source_key"])
    first = lambda d, name: d.groupBy("case_key", "claim_key").agg(F.min("place").alias("place")).groupBy("case_key", "place").agg(F.count("*").alias(name))
    d = arrivals.join(first(e, "new_claims"), ["case_key", "place"], "left").join(first(e.where(F.col("relation") == "contradicts"), "new_contradictions"), ["case_key", "place"], "left")
    d = d.fillna(0, ["new_claims", "new_contradictions"]).withColumn("idle", (F.col("new_claims") == 0) & (F.col("new_contradictions") == 0))
    w = Window.partitionBy("case_key").orderBy("place")
    d = d.withColumn("nth", F.row_number().over(w))
    last = F.max(F.when(~F.col("idle"), F.col("nth"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("run", F.col("nth") - F.coalesce(last, F.lit(0)))


def coverage(claims: DataFrame, placed: DataFrame) -> DataFrame:
    """(case_key, covered_at, uncovered, weak_core, searched) by claims (case_key, claim_key, target, core, searched) and edges with their place.

    Each target needs a source that doesn't contradict, each core claim two. `covered_at` is the place from which both hold, null if they never do.
    """
    keys = ["case_key", "claim_key"]
    # Partial limits keep all but a claim's first sources from being shuffled.
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("place", "source_key"))
    support = placed.where(F.col("relation") != "contradicts").select(*keys, "source_key", "place").withColumn("_n", rank).where(F.col("_n") <= CORE_SOURCES)
    d = claims.join(support.groupBy(*keys).agg(F.min("place").alias("first"), F.min(F.when(F.col("_n") == CORE_SOURCES, F.col("place"))).alias("enough")), keys, "left")
    by_target = d.where(F.col("target").isin(*TARGETS)).groupBy("case_key", "target").agg(F.min("first").alias("first"))
    targets = by_target.where(F.col("first").isNotNull()).groupBy("case_key").agg(F.max("first").alias("targets_at"), F.array_sort(F.collect_set("target")).alias("have"))
    core = F.col("core") & F.col("enough").isNull()
    claimed = d.groupBy("case_key").agg(
        F.array_sort(F.collect_set(F.when(core, F.col("claim_key")))).alias("weak_core"), F.max(F.when(F.col("core"), F.col("enough"))).alias("core_at"),
        F.coalesce(F.every(F.col("searched") | ~F.coalesce(F.col("target").isin(*TARGETS), F.lit(False))), F.lit(False)).alias("searched"),
    )
    d = claimed.join(targets, "case_key", "left")
    uncovered = F.array_except(F.array(*[F.lit(x) for x in TARGETS]), F.coalesce("have", F.array().cast("array<string>")))
    d = d.withColumn("uncovered", uncovered)
    at = F.greatest("targets_at", F.coalesce("core_at", "targets_at"))
    return d.select("case_key", F.when((F.size("uncovered") == 0) & (F.size("weak_core") == 0), at).alias("covered_at"), "uncovered", "weak_core", "searched")


def _apart(value: Column, over: Window) -> Column:
    """Whether a value differs from the first that is not null."""
    return F.coalesce(value != F.first(value, ignorenulls=True).over(over), F.lit(False))


def stop_rule(claims: DataFrame, arrivals: DataFrame, edges: DataFrame | None, run: int = IDLE_RUN, least_sources: int = 0) -> DataFrame:
    """For each case, where its search may stop.

    `arrivals` (case_key, place, source_key, country, institution, kind, publisher) are the sources in the order in which they were found, each once;
    `claims` and `edges` as in `coverage` and `news`; without `edges` arrivals have them as a column, array of {claim_key, relation}. `ready_at` is the first place with coverage, a counter-search
    of every key claim, and sources of two countries or institutions, its papers not all of one publisher. `saturated_at` ends the first run of idle sources; `stop_at` is the first place that ends
    such a run and is ready. `short` says that there are fewer sources than asked for where the search may stop. The places are null where they are never reached.

    The arrivals with their edges are stored once; claims and places read some columns each, a case's rows side by side, so that aggregations shrink them before they are shuffled.
    """
    if edges is not None:
        of = edges.groupBy("case_key", "source_key").agg(F.collect_set(F.struct("claim_key", "relation")).alias("edges"))
        arrivals = arrivals.join(of, ["case_key", "source_key"], "left")
    by_place = Window.partitionBy("case_key").orderBy("place")
    so_far = by_place.rowsBetween(Window.unboundedPreceding, 0)
    paper = F.coalesce(F.col("kind") == "paper", F.lit(False))
    d = arrivals.withColumns({"nth": F.row_number().over(by_place), "_diverse": _apart(F.col("country"), so_far) | _apart(F.col("institution"), so_far), "_journals": _apart(F.when(paper, F.struct("publisher")), so_far)})
    varied = F.max("_diverse").over(so_far) & (~F.max(paper).over(so_far) | F.max("_journals").over(so_far))
    d = stored(d.select("case_key", "place", "nth", varied.alias("varied"), "edges"))
    placed = d.select("case_key", F.col("place").alias("source_key"), "place", F.inline("edges"))
    first = placed.groupBy("case_key", "claim_key").agg(F.array(F.min("place"), F.min(F.when(F.col("relation") == "contradicts", F.col("place")))).alias("at"))
    breaks = first.groupBy("case_key").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("breaks"))
    d = d.drop("edges").join(coverage(claims, placed).select("case_key", "covered_at", "searched").join(breaks, "case_key", "full"), "case_key", "left")
    ready = F.coalesce("searched", F.lit(False)) & F.coalesce(F.col("place") >= F.col("covered_at"), F.lit(False)) & F.col("varied")
    last = F.max(F.when(F.array_contains("breaks", F.col("place")), F.col("nth"))).over(so_far)
    saturated = F.col("run") >= run
    first = lambda when, x="place": F.min(F.when(when, F.col(x)))
    d = d.withColumn("run", F.col("nth") - F.coalesce(last, F.lit(0))).withColumn("ready", ready)
    out = d.groupBy("case_key").agg(F.count("*").alias("sources"), first(F.col("ready")).alias("ready_at"), first(saturated).alias("saturated_at"), first(F.col("ready") & saturated).alias("stop_at"), first(F.col("ready"), "nth").alias("_n"))
    return out.withColumn("short", F.coalesce(F.col("_n") < least_sources, F.lit(False))).drop("_n")


def review_share(docs: DataFrame) -> DataFrame:
    """(doc_id, body_sources, review_sources, share, enough): different sources cited in the review chapter over those of the whole body.

    One aggregation with GROUPING SETS by document and by document and kind of chapter. The body ends at the references; a document whose body cites nothing has no share, and fails.
    """
    d = docs.select("doc_id", refs_boundary_last(F.col("text"))[0].alias("body"))
    parts = chapters(d.select("doc_id", F.col("body").alias("text"))).select("doc_id", F.col("title").rlike(REVIEW_CHAPTER).alias("review"), "block")
    front = d.select("doc_id", F.lit(False).alias("review"), F.col("body").alias("block"))
    cited = parts.where("review").unionByName(front).select("doc_id", "review", F.explode(F.array_distinct(F.regexp_extract_all("block", F.lit(SOURCE_MARK), F.lit(1)))).alias("source"))
    sets = cited.groupingSets([["doc_id"], ["doc_id", "review"]], "doc_id", "review").agg(F.count_distinct("source").alias("n"), F.grouping("review").alias("whole"))
    n = sets.groupBy("doc_id").agg(F.max(F.when(F.col("whole") == 1, F.col("n"))).alias("body_sources"), F.max(F.when((F.col("whole") == 0) & F.col("review"), F.col("n"))).alias("review_sources"))
    out = docs.select("doc_id").join(n, "doc_id", "left").fillna(0, ["body_sources", "review_sources"])
    share = F.col("review_sources") / F.nullif("body_sources", F.lit(0))
    return out.withColumns({"share": F.bround(share, 3), "enough": F.coalesce(10 * F.col("review_sources") >= int(10 * REVIEW_SHARE) * F.col("body_sources"), F.lit(False)) & (F.col("body_sources") > 0)})


def review_gate(docs: DataFrame, claims: DataFrame, edges: DataFrame) -> DataFrame:
    """L8 in full: share of the review chapter, targets without a source and core claims with fewer than two, for drafts whose id is their case."""
    unplaced = edges.withColumn("place", F.xxhash64("source_key"))
    c = coverage(claims, unplaced).select(F.col("case_key").alias("doc_id"), "uncovered", "weak_core")
    d = review_share(docs).join(c, "doc_id", "left")
    # A draft without claims covers nothing.
    d = d.withColumns({"uncovered": F.coalesce("uncovered", F.array(*[F.lit(x) for x in TARGETS])), "weak_core": F.coalesce("weak_core", F.array().cast(c.schema["weak_core"].dataType))})
    return d.withColumn("passed", F.col("enough") & (F.size("uncovered") == 0) & (F.size("weak_core") == 0))


def entry_verdict(gaps: DataFrame) -> DataFrame:
    """(case_key, blocking, high, verdict) by gaps (case_key, grade, fillable, bridgeable); grades are blocking, high and acceptable.

    `enter` without blocking and with at most one high gap; `conditional` without blocking ones, if all high ones can be bridged by adjacent evidence; `stop` with several blocking gaps that
    no search can fill; else `search`. Unknown is no: a null says that a gap can't be filled or bridged.
    """
    is_ = lambda g: F.col("grade") == g
    no = lambda x: ~F.coalesce(F.col(x), F.lit(False))
    d = gaps.groupBy("case_key").agg(
        F.count_if(is_("blocking")).alias("blocking"), F.count_if(is_("high")).alias("high"),
        F.count_if(is_("blocking") & no("fillable")).alias("_unfillable"), F.count_if(is_("high") & no("bridgeable")).alias("_open"),
    )
    none = F.col("blocking") == 0
    verdict = F.when(none & (F.col("high") <= 1), "enter").when(none & (F.col("_open") == 0), "conditional").when((F.col("blocking") > 1) & (F.col("_unfillable") > 1), "stop").otherwise("search")
    return d.withColumn("verdict", verdict).drop("_unfillable", "_open")


def usable(access: Column, role: Column, checkable: Column) -> Column:
    """What a source may be used for: `core` argument, `support` that doesn't stand alone, `auxiliary` citation, or `none`.

    Only core and supporting roles enter the evidence map. A source that couldn't be fetched serves as auxiliary if its URL and publication can be checked against each other.
    """
    allowed = F.coalesce(role.isin("core", "supporting"), F.lit(False))
    found = F.when(access == "confirmed", "core").when(access == "web_accessible", "support").when((access == "unavailable") & F.coalesce(checkable, F.lit(False)), "auxiliary").otherwise("none")
    return F.when(allowed, found).otherwise("none")
