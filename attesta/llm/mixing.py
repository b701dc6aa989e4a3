"""Operator 10, mixing sources to target weights by weighted fair queueing.

Every shuffled document has a virtual finish time: the cumulative tokens of its source, itself
included, divided by the source's target. All sources reach time 1 when their targets are met;
the copies of all documents, range-sorted by finish time over the whole corpus, are cut where the total budget is spent:
sums of the sorted parts say which part holds the cut, and a running sum within that part where.

Running sums over a source never meet in one task. Documents are dealt to (source, bucket) by
their shuffle key; sums of buckets give each bucket its offset. A hot source has as many buckets
as its rows need.

Edge cases. A null text has size 0. A null source is a source of its own and comes last. Empty
tables give empty results. Rows that repeat a document count as documents of their own; those
that are equal in id, source and text are interchangeable and are taken alike. Equal finish times go by source, then shuffle key.
A source without words has target 0. Very long texts count whole. Other columns are kept, whatever their names. The
budget is a sum of decimals, so that reruns agree to the last document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm import common as c

#: Rows that a bucket of the running sums holds on average, or the root of their number if that is more.
BUCKET_ROWS = 2_000
_O = c.OWN


def targets(sizes: DataFrame, weights: tuple[float, ...], max_copies: float, budget_share: float = 1.0) -> DataFrame:
    """`sizes` (no_source, source, source_size) with `target`.

    Weights repeat over the sources in order. A target stops at `max_copies` times its source's
    size, the excess goes to the others by weight: with sources in order of cap / weight, those
    before the first whose cap is not below its share of what is left are capped.
    """
    order = Window.orderBy("no_source", "source")
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("_w", F.element_at(w, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(max_copies))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_ratio", "no_source", "source")
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(budget_share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    s = s.withColumn("_level", left / F.sum("_w").over(after))
    s = s.withColumn("_level", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(whole)["_level"])
    return s.select("no_source", "source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    shuffle_key: Column,
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_copies: int = 3,
    budget_share: float = 1.0,
) -> DataFrame:
    """`docs` with __attesta_ columns size, source_size, target, finish (of the first copy) and copies.

    `size` and `shuffle_key` (a 64-bit hash) are expressions over `docs`. `copies` says how often
    the mix takes a document, from 0 to `max_copies`.
    """
    own = {n: f"{_O}{n}" for n in ("size", "key", "bucket", "source", "no_source")}
    rows = docs.withColumns({own["size"]: size, own["key"]: F.shiftrightunsigned(shuffle_key, 1), own["source"]: F.coalesce(F.col(source_col).cast("string"), F.lit("")), own["no_source"]: F.col(source_col).isNull()})
    slim = c.written(rows.select(*[F.col(own[n]).alias(n) for n in ("size", "key", "source", "no_source")]), "mix")
    kept, n = slim, slim.count()
    n_buckets = max(1, math.ceil(n / max(BUCKET_ROWS, math.isqrt(n))))
    slim = slim.withColumn("bucket", _bucket(F.col("key"), n_buckets))

    sums = slim.groupBy("no_source", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goals = targets(sums.groupBy("no_source", "source").agg(F.sum("bucket_size").alias("source_size")), weights, max_copies, budget_share)
    offset = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("no_source", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = c.written(sums.withColumn("offset", offset).join(goals, ["no_source", "source"]).drop("bucket_size"), "mix-offsets")

    def queued(rows: DataFrame, size: str, key: str, group: list[str]) -> Column:
        return F.sum(size).over(Window.partitionBy(*group).orderBy(key, size).rowsBetween(Window.unboundedPreceding, 0)) + F.col("offset")

    group = ["no_source", "source", "bucket"]
    times = slim.join(offsets, group).withColumn("cum", queued(slim, "size", "key", group)).where((F.col("target") > 0) & (F.col("size") > 0))
    finish = lambda cum, e: (e * F.col("source_size") + cum) / F.col("target")
    times = times.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_copies - 1)), lambda e: finish(F.col("cum"), e))).alias("finish"), "no_source", "source", "key", "size")
    cut = _cut(times, offsets)
    c.drop_written(kept)

    offsets = offsets.select(*[F.col(n).alias(f"{_O}{n}") for n in group], "offset", F.col("source_size").alias(f"{_O}source_size"), F.col("target").alias(f"{_O}target"))
    offsets = offsets.withColumnRenamed("offset", f"{_O}offset")
    out = rows.withColumn(own["bucket"], _bucket(F.col(own["key"]), n_buckets)).join(offsets, [own[n] for n in group])
    cum = F.sum(own["size"]).over(Window.partitionBy(*[own[n] for n in group]).orderBy(own["key"], own["size"]).rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"{_O}offset")
    out = out.withColumn(f"{_O}cum", cum)
    some = (F.col(f"{_O}target") > 0) & (F.col(own["size"]) > 0)
    # A copy is taken if it doesn't come after the last one that the budget holds.
    copies = F.lit(0)
    for e in range(max_copies):
        place = F.struct(_finish(e).alias("finish"), F.col(own["no_source"]).alias("no_source"), F.col(own["source"]).alias("source"), F.col(own["key"]).alias("key"), F.col(own["size"]).alias("size"))
        copies = copies + (place <= cut if cut is not None else F.lit(False)).cast("int")
    out = out.withColumn(f"{_O}copies", F.when(some, copies).otherwise(0)).withColumn(f"{_O}finish", F.when(some, _finish(0)))
    return out.drop(*[own[n] for n in ("key", "bucket", "source", "no_source")], f"{_O}offset", f"{_O}cum")


def _bucket(key: Column, n_buckets: int) -> Column:
    """Even ranges of the 63-bit keys: buckets follow each other as their keys do."""
    return F.least(F.floor(key.cast("double") / float(1 << 63) * n_buckets), F.lit(n_buckets - 1)).cast("int")


def _finish(copy: int | Column) -> Column:
    """The finish time of a document's copy, counted from 0."""
    return (copy * F.col(f"{_O}source_size") + F.col(f"{_O}cum")) / F.col(f"{_O}target")


def _cut(times: DataFrame, offsets: DataFrame) -> Column | None:
    """The place (finish, no_source, source, key, size) of the last copy within the budget, the sum of all targets; null if there is none.

    All copies are range-sorted and written, so that a lost executor can't move the borders of the parts.
    """
    goals = offsets.select("no_source", "source", "target").distinct()
    # Decimals sum alike in any order; what rounding took from single targets is put back.
    budget = goals.agg(F.round(F.sum(F.col("target").cast("decimal(38,6)")), 3)).first()[0]
    if not budget:
        return None
    order = ["finish", "no_source", "source", "key", "size"]
    ordered = c.written(times.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "mix-order")
    parts = ordered.groupBy("part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("before", F.sum("part_size").over(Window.orderBy("part")) - F.col("part_size"))
    # The part where the budget ends, or the last one if it never does.
    last = parts.where(F.col("before") <= F.lit(budget)).orderBy(F.desc("part")).first()
    running = ordered.where(F.col("part") == last["part"]).withColumn("cum", F.sum("size").over(Window.partitionBy("part").orderBy(*order)) + F.lit(last["before"]))
    place = running.where(F.col("cum") <= F.lit(budget)).agg(F.max(F.struct(*order)).alias("p")).first()["p"]
    if place is None and last["before"]:
        place = ordered.where(F.col("part") < last["part"]).agg(F.max(F.struct(*order)).alias("p")).first()["p"]
    c.drop_written(ordered)
    return place and F.struct(*[F.lit(place[x]).cast(times.schema[x].dataType).alias(x) for x in order])


def in_order(mixed: DataFrame) -> DataFrame:
    """The copies that `mix` takes, range-sorted by their own finish times."""
    again = F.posexplode(F.sequence(F.lit(1), F.col(f"{_O}copies")))
    out = mixed.where(F.col(f"{_O}copies") > 0).select("*", again.alias(f"{_O}copy", f"{_O}nth"))
    later = F.col(f"{_O}finish") + F.col(f"{_O}copy") * F.col(f"{_O}source_size") / F.col(f"{_O}target")
    out = out.withColumn(f"{_O}finish", later).drop(f"{_O}nth")
    return out.repartitionByRange(f"{_O}finish").sortWithinPartitions(f"{_O}finish")


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[Column, Column]:
    """Size and shuffle key of a document: its words, and 64 bits of the MD5 of id, source and text."""
    parts = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (id_col, source_col, text_col)]
    digest = F.md5(F.concat_ws("\x01", *parts).cast("binary"))
    return c.n_words(F.col(text_col)), F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir)
    size, key = sized_documents(docs)
    slim = docs.select("doc_id", "source", size.alias("size"), key.alias("key"))
    out = mix(slim, F.col("size"), F.col("key"))
    taken = (F.col(f"{_O}copies") * F.col("size")).cast("long")
    return out.select("doc_id", F.col("size"), F.col(f"{_O}source_size").alias("source_size"), F.col(f"{_O}target").alias("target"), taken.alias("taken"), F.col(f"{_O}finish").alias("finish"))


ORACLE_SQL = {
    "op10_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(chr(1), coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), coalesce(text, ''))), 1, 16))::UBIGINT >> 1 AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, list_extract([5::DOUBLE, 2::DOUBLE, 1::DOUBLE], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w FROM d GROUP BY source
), caps AS (
  SELECT *, source_size * 3::DOUBLE AS cap, source_size * 3::DOUBLE / w AS ratio FROM s
), levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps WINDOW o AS (ORDER BY ratio, source NULLS LAST)
), goals AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, level LIMIT 1) * w, cap)) AS target FROM levels
), queue AS (
  SELECT d.*, g.source_size, g.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM d JOIN goals g ON g.source IS NOT DISTINCT FROM d.source
), copies AS (
  SELECT doc_id, source, key, size, (e * source_size + cum) / target AS finish FROM queue, range(3) t(e) WHERE target > 0 AND size > 0
), spent AS (
  SELECT doc_id, source, key, sum(size) OVER (ORDER BY finish, source IS NULL, source, key, size) AS total FROM copies
), taken AS (
  SELECT doc_id, source, key, count(*) AS n FROM spent WHERE total <= (SELECT round(sum(target::DECIMAL(38, 6)), 3) FROM goals) GROUP BY ALL
)
SELECT q.doc_id, size, source_size, target, (coalesce(n, 0) * size)::BIGINT AS taken, CASE WHEN target > 0 AND size > 0 THEN cum / target END AS finish
FROM queue q LEFT JOIN taken t ON t.doc_id IS NOT DISTINCT FROM q.doc_id AND t.source IS NOT DISTINCT FROM q.source AND t.key = q.key
"""
}
