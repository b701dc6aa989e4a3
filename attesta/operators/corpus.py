"""The corpus of sources: its self-check, ranking, selection and write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta import contracts as k
from attesta.functions.evidence import blank, filled, lookup
from attesta.functions.urls import suspect_domain


def problems(sources: DataFrame, domains: tuple[str, ...] = k.SUSPECT_DOMAINS, quota: int = 0) -> DataFrame:
    """(case_id, source_id, problem, detail), one row for each thing wrong.

    A row without id has that one problem. `pos` orders a case's rows. One scan of the sources
    gives the problems of rows; duplicates and the quota are aggregates.
    """
    s = sources.withColumns({x: F.trim(F.coalesce(x, F.lit(""))) for x in ("source_id", "url", "access_status", "authority", "freshness", "source_origin", "type")})
    problem = lambda when, name, detail="": F.when(when, F.struct(F.lit(name).alias("problem"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))
    legal = lambda x, values: F.col(x).isin(*values)
    known = F.col("source_id") != ""
    again = F.row_number().over(Window.partitionBy("case_id", "source_id").orderBy("pos")) > 1
    s = s.withColumns({"again": again, "dom": suspect_domain(F.col("url"), domains)})
    found = F.array_compact(F.array(
        problem(~known, "empty_id"),
        problem(known & F.col("again"), "duplicate_id"),
        problem(known & (filled(F.col("title"), F.col("title_or_name")) == ""), "missing_title"),
        problem(known & F.col("dom").isNotNull(), "suspect_domain", F.col("dom")),
        problem(known & (F.col("url") == ""), "missing_url"),
        problem(known & (F.col("access_status") == ""), "empty_access_status"),
        problem(known & (F.col("authority") == ""), "missing_authority"),
        problem(known & (F.col("authority") != "") & ~legal("authority", k.AUTHORITIES), "illegal_authority", F.col("authority")),
        problem(known & (F.col("freshness") == ""), "missing_freshness"),
        problem(known & (F.col("freshness") != "") & ~legal("freshness", k.FRESHNESS), "illegal_freshness", F.col("freshness")),
        problem(known & (F.col("freshness") == "superseded"), "superseded"),
        problem(known & (F.col("source_origin") != "") & ~legal("source_origin", k.SOURCE_ORIGINS), "illegal_origin", F.col("source_origin")),
    ))
    rows = s.select("case_id", "source_id", F.explode(found).alias("p")).select("case_id", "source_id", "p.*")
    rows = rows.unionByName(duplicate_urls(s.where(known)).select("case_id", F.lit("").alias("source_id"), F.lit("duplicate_url").alias("problem"), F.concat_ws(" ", F.array_join("ids", ","), "url").alias("detail")))
    if quota > 0:
        few = s.where(known).groupBy("case_id").agg(F.count_if(F.col("type") == "journal_paper").alias("n")).where(F.col("n") < quota)
        rows = rows.unionByName(few.select("case_id", F.lit("").alias("source_id"), F.lit("journal_quota").alias("problem"), F.col("n").cast("string").alias("detail")))
    return rows


def duplicate_urls(sources: DataFrame) -> DataFrame:
    """A4: (case_id, url, ids) of URLs that more than one entry has."""
    some = sources.where(~blank(F.col("url"))).groupBy("case_id", "url").agg(F.sort_array(F.collect_list("source_id")).alias("ids"))
    return some.where(F.size("ids") > 1)


def ranked(registry: DataFrame) -> DataFrame:
    """Authority and priority of registry rows (id, category): an override by id wins over the category's default."""
    pick = lambda i, other: F.coalesce(lookup(F.col("id"), {x: r[i] for x, r in k.SOURCE_RANKS.items()}, None), lookup(F.col("category"), {x: r[i] for x, r in k.CATEGORY_RANKS.items()}, None), F.lit(other))
    return registry.withColumns({"authority": pick(0, ""), "priority": pick(1, k.DEFAULT_PRIORITY)})


def routed_categories(domain: str) -> tuple[str, ...]:
    """the categories that a topic's domain searches; none: all."""
    if domain not in k.ROUTING:
        raise ValueError(f"unknown topic domain {domain!r}; known: {', '.join(sorted(k.ROUTING))}")
    return k.ROUTING[domain]


def selected(registry: DataFrame, domain: str) -> DataFrame:
    """Rows of the domain's categories by priority, then id; an unknown domain is an error."""
    rows, categories = ranked(registry), routed_categories(domain)
    rows = rows.where(F.col("category").isin(*categories)) if categories else rows
    return rows.withColumn("verify_current", F.col("category").contains("standard") | F.col("category").contains("标准")).orderBy(F.desc("priority"), "id")


def collected(rows: DataFrame) -> DataFrame:
    """SC3: sources of several files (file, pos, id, url, title): the first URL of an id fills the gaps of its other rows;
    rows without id or URL go; of each id and URL the first stays."""
    order = Window.partitionBy("id").orderBy("file", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    url = F.when(blank(F.col("url")), None).otherwise(F.trim("url"))
    filled_ = rows.withColumn("url", url).withColumn("url", F.coalesce("url", F.first("url", ignorenulls=True).over(order)))
    filled_ = filled_.where(~blank(F.col("id")) & F.col("url").isNotNull())
    return filled_.withColumn("_n", F.row_number().over(Window.partitionBy("id", "url").orderBy("file", "pos"))).where("_n = 1").drop("_n")


def write_back(corpus: DataFrame, downloads: DataFrame) -> DataFrame:
    """SK4, J8: access status by the last download of each source; other statuses change nothing."""
    status = lookup(F.col("status"), k.ACCESS_BY_DOWNLOAD, None)
    last = downloads.groupBy("source_id").agg(F.max_by("status", "pos").alias("status")).select("source_id", status.alias("_new"))
    return corpus.join(last, "source_id", "left").withColumn("access_status", F.coalesce("_new", "access_status")).drop("_new")


def role_allowed(roles: list[str], include_all: bool = False) -> Column:
    """a source without a role passes."""
    return F.lit(True) if include_all else (blank(F.col("role")) | F.col("role").isin(roles))


def next_ids(new: DataFrame, used: DataFrame) -> DataFrame:
    """Ids S1, S2, ... that `used` (source_id) lacks, for the rows of `new` by `pos`.

    The free ids below the number of rows in both are enough; only they are numbered.
    """
    n = new.count() + used.count()
    free = new.sparkSession.range(1, n + 1).withColumn("source_id", F.concat(F.lit("S"), F.col("id").cast("string"))).join(used, "source_id", "left_anti")
    free = free.withColumn("_n", F.row_number().over(Window.orderBy("id"))).select("source_id", "_n")
    return new.withColumn("_n", F.row_number().over(Window.orderBy("pos"))).join(free, "_n").drop("_n")
