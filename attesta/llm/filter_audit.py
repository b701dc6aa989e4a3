"""Operator 12, audit of how filters interact, by a cube over their failure flags.

Each document is flagged by every filter on its own. Flags and part are counted first, so that a CUBE over them has few
rows to expand, whatever the corpus. Its row of a grouping set in which the selected flags are all false counts the
documents that survive that subset of filters in that part. Every step of every order of the filters is then a pair of subsets, with and
without the step's filter, and a join of the survivors of both: what it removes, keeps and loses needs no further look at documents.

Copies: a document fails if a row with a smaller id has its text, removed or not. Least ids are aggregated by SHA-256 of the text,
only texts that several rows have are joined back; they are broadcast if few, else adaptive execution splits a text that many rows have.

Edge cases. A null text counts as empty; an empty one has no words (fails A, nothing else by itself). Null ids are neither smaller nor greater than others,
so such rows neither fail by E nor make others fail, and have no labels. Rows that repeat an id and its text both stay by E. A null part is the empty string,
and joins one that is the empty string already. A document is good or toxic if any label row of its id says so; null labels say nothing. An empty table
gives no rows. Very long texts are flagged whole. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import common as c

FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
#: Texts with copies that are broadcast, at most; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that isn't null."""
    words = F.array_remove(F.split(text, c.SPACE, -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 100,
        "B": 100 * distinct.cast("long") < 80 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), c.text_key(F.col(text_col)).alias("key"), *[x.alias(k) for k, x in failures(text).items()])
    rows = c.written(rows, "audit-rows")
    least = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies")).where(F.col("copies") > 1).drop("copies")
    least = c.sized_broadcast(c.written(least, "audit-copies"), BROADCAST_ROWS)
    said = lambda x: F.coalesce(F.max(F.col(x) == 1), F.lit(False))
    judged = labels.groupBy(F.col("doc_id").alias("id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    out = rows.join(least, "key", "left").join(judged, "id", "left")
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return out.select("part", *"ABCD", copy.alias("E"), *[F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "toxic")])


def survivors(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, subset, n, good, toxic): documents that no filter of the subset removes; zeros included. The first filter is the highest bit."""
    counted = lambda x: F.sum(F.col(x).cast("long")).alias(x)
    counts = c.written(rows.groupBy("part", *filters).agg(F.count("*").alias("n"), counted("good"), counted("toxic")), "audit-counts")
    cube = counts.cube("part", *filters).agg(*[counted(x) for x in MEASURES], F.grouping_id().alias("rolled"))
    every = (1 << len(filters)) - 1
    passed = cube.where(F.col("rolled") <= every)
    for f in filters:
        passed = passed.where(~F.coalesce(F.col(f), F.lit(False)))
    passed = passed.select("part", (every - F.col("rolled")).cast("int").alias("subset"), *MEASURES)
    grid = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(every))).alias("subset"))
    return c.written(grid.join(passed, ["part", "subset"], "left").fillna(0, list(MEASURES)), "audit-survivors")


def interactions(left: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from what every subset leaves."""
    spark, k = left.sparkSession, len(filters)
    bit = {f: 1 << (k - 1 - i) for i, f in enumerate(filters)}
    every = (1 << k) - 1
    # In how many orders a set of filters stands before f, in any order.
    weight = lambda s: math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count())
    pairs = [(f, s, s | b, weight(s)) for f, b in bit.items() for s in range(every + 1) if not s & b]
    steps = [("".join(o), i + 1, f, sum(bit[x] for x in o[:i])) for o in itertools.permutations(filters) for i, f in enumerate(o)]
    pair_table = spark.createDataFrame(pairs, "filter string, before int, after int, weight long")
    step_table = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int")

    with_, without = ("a_", "after"), ("b_", "before")
    side = lambda p, subset: left.select(F.col("part").alias(f"{p}part"), F.col("subset").alias(subset), *[F.col(x).alias(f"{p}{x}") for x in MEASURES])
    drops = pair_table.join(side(*without), "before").join(side(*with_), "after").where(F.col("a_part") == F.col("b_part"))
    lost = {"removed": "n", "good_lost": "good", "toxic_lost": "toxic"}
    drops = drops.select(F.col("a_part").alias("part"), "filter", "before", "after", "weight", F.col("a_n").alias("kept"), *[(F.col(f"b_{x}") - F.col(f"a_{x}")).alias(name) for name, x in lost.items()])
    drops = c.written(drops, "audit-drops")
    only = lambda when: F.sum(F.when(when, F.col("removed")).otherwise(0))
    whole = drops.groupBy("part", "filter").agg(
        only(F.col("before") == 0).alias("failing"), only(F.col("after") == every).alias("unique_fails"), F.sum(F.col("weight") * F.col("removed")).alias("shapley")
    )
    out = step_table.join(drops, ["filter", "before"]).join(whole, ["part", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(c.documents(spark, sf_dir).select("doc_id", "text", "lang"), c.documents(spark, sf_dir, "labels"))
    return interactions(survivors(rows))


ORACLE_SQL = {
    "op12_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(judged.toxic, 0) AS toxic, {
    'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
  FROM texts LEFT JOIN judged USING (doc_id)
), long AS (
  SELECT row_number() OVER () AS i, * FROM flags
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS before FROM orders, range(1, 6) r(step)
), fails AS (
  SELECT i, part, good, toxic, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END) || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS failed FROM long
), groups AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL
), walked AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, contains(failed, x) AS hit, translate(failed, before, '') <> failed AS gone FROM groups, steps) GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM walked
"""
}
