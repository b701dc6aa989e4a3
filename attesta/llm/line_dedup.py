"""Operator 9, line dedup by content-defined chunks of lines.

Lines are hashed, and a rolling hash over each line and the one before it ends a chunk where it is
divisible by MEAN_LINES, so that a passage falls into the same chunks wherever it stands and
whatever was inserted before it. Chunks of two or more lines that occur more than once over all
documents are candidates by a 64-bit hash; candidates are grouped by their bytes, and all but the
first occurrence, by id (null last), content of the document and line, are removed.

The query's passages are found if the chunks within them are whole; what lies before their first
and after their last boundary stays, as do repeated single lines. Its SQL sets that rule. The
pipeline asks for all repeated passages of two or more lines instead (`anywhere`): every two
neighbouring lines, of which one has a word, are a chunk, so that what repeats depends on no
boundary, and a line goes if it lies in one that occurred before. The first occurrence of each
different line stays.

Edge cases. A null text stays null and has no lines; an empty one has one empty line. Rows that
repeat both id and text count as one document. A document may lose all its lines and then has the
empty text. Very long texts are cut into chunks whole; a chunk that all documents have is compared in many tasks. Other columns are
kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import common as c

#: Lines of a chunk, on average.
MEAN_LINES = 2
#: Hashes that are broadcast rather than shuffling texts to them, at most; of documents that lose chunks a quarter, and BROADCAST_BYTES of them.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Chunks with one hash that a task compares, on average.
HOT = 256


def line_hash(line: Column) -> Column:
    """32 bits of a line's MD5, as a number."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks(docs: DataFrame, id_col: str, text_col: str, mean_lines: int) -> DataFrame:
    """(id, key, start, stop, hash, body) of each chunk of two or more lines; lines are counted from 0, stop is exclusive."""
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), c.text_key(F.col(text_col)).alias("key"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    d = d.where(F.size("lines") > 1).withColumn("h", F.transform("lines", line_hash))
    rolling = lambda i: (F.get("h", i) + 31 * F.coalesce(F.get("h", i - 1), F.lit(0))) % mean_lines
    ends = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: (rolling(i) == 0) | (i == F.size("h") - 1))
    d = d.withColumn("ends", ends).drop("h")
    parts = F.transform("ends", lambda e, j: F.struct((F.coalesce(F.get("ends", j - 1), F.lit(-1)) + 1).alias("start"), (e + 1).alias("stop")))
    d = d.withColumn("part", F.explode(F.filter(parts, lambda p: p["stop"] - p["start"] > 1)))
    body = F.array_join(F.slice("lines", F.col("part.start") + 1, F.col("part.stop") - F.col("part.start")), "\n")
    return d.select("id", "key", "part.start", "part.stop", body.alias("body")).withColumn("hash", F.xxhash64("body"))


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same of every two neighbouring lines that aren't both without words."""
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), c.text_key(F.col(text_col)).alias("key"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    d = d.where(F.size("lines") > 1).withColumn("start", F.explode(F.sequence(F.lit(0), F.size("lines") - 2)))
    d = d.select("id", "key", "start", (F.col("start") + 2).alias("stop"), F.concat_ws("\n", F.get("lines", F.col("start")), F.get("lines", F.col("start") + 1)).alias("body"))
    return d.where(F.col("body").rlike(c.WORD)).withColumn("hash", F.xxhash64("body"))


def merged(spans: Column) -> Column:
    """Spans of two lines, any of which may meet, as spans that don't."""
    lines = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda g: F.array(g["start"], g["start"] + 1)))))
    # A line begins a span if the one before it is not gone, and ends one if the one after is not.
    starts = lambda ls: F.filter(ls, lambda x, j: F.coalesce(F.get(ls, j - 1) + 1 != x, F.lit(True)))
    stops = lambda ls: F.filter(ls, lambda x, j: F.coalesce(F.get(ls, j + 1) - 1 != x, F.lit(True)))
    return F.transform(F.array(lines), lambda ls: F.zip_with(starts(ls), stops(ls), lambda a, z: F.struct(a.alias("start"), (z + 1).alias("stop"))))[0]


def removals(docs: DataFrame, id_col: str, text_col: str, mean_lines: int, anywhere: bool = False) -> DataFrame:
    """(id, key, gone: array of {start, stop}) for each document that loses chunks."""
    found = windows(docs, id_col, text_col) if anywhere else chunks(docs, id_col, text_col, mean_lines)
    shared = c.written(found.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > 1), "line-hashes")
    place = F.struct(F.col("id").isNull().alias("null"), "id", "key", "start")
    # What a hash has more than HOT times is dealt to as many tasks as it needs; each gets the first place.
    salts = F.ceil(F.col("n") / HOT).cast("int")
    candidates = found.join(c.sized_broadcast(shared, BROADCAST_ROWS), "hash").withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64(place), F.col("salts")).cast("int"))
    candidates = c.written(candidates.drop("n"), "line-chunks")
    firsts = candidates.groupBy("hash", "body", "salt").agg(F.count("*").alias("n"), F.max("salts").alias("salts"), F.min(place).alias("first"))
    firsts = firsts.groupBy("hash", "body").agg(F.sum("n").alias("n"), F.max("salts").alias("salts"), F.min("first").alias("first")).where(F.col("n") > 1)
    firsts = firsts.select("hash", "body", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    gone = candidates.join(firsts, ["hash", "body", "salt"]).where(~place.eqNullSafe(F.col("first")))
    gone = gone.groupBy("id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    gone = c.written(gone.withColumn("gone", merged(F.col("gone"))) if anywhere else gone, "line-gone")
    c.drop_written(shared, candidates)
    return gone


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_lines: int = MEAN_LINES, anywhere: bool = False) -> DataFrame:
    """`docs` with its text cut, and with __attesta_ columns lines and removed_lines."""
    gone = removals(docs, id_col, text_col, mean_lines, anywhere)
    key, own = f"{c.OWN}key", f"{c.OWN}gone"
    d = docs.withColumn(key, c.text_key(F.col(text_col)))
    gone = c.sized_broadcast(gone, BROADCAST_ROWS // 4, F.size("gone") * 16 + 100, BROADCAST_BYTES).select(F.col("id").alias(f"{c.OWN}id"), F.col("key").alias(f"{c.OWN}gone_key"), F.col("gone").alias(own))
    d = d.join(gone, (d[key] == gone[f"{c.OWN}gone_key"]) & d[id_col].eqNullSafe(gone[f"{c.OWN}id"]), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    # Sorted removals cut the lines into the pieces between them.
    d = d.withColumn(own, F.sort_array(own))
    before = F.transform(own, lambda g, j: F.array_join(F.slice(f"{c.OWN}all", F.coalesce(F.get(own, j - 1)["stop"], F.lit(0)) + 1, g["start"] - F.coalesce(F.get(own, j - 1)["stop"], F.lit(0))), "\n"))
    starts = F.transform(own, lambda g, j: g["start"] > F.coalesce(F.get(own, j - 1)["stop"], F.lit(0)))
    last = F.element_at(own, -1)["stop"]
    n = F.size(f"{c.OWN}all")
    tail = F.when(last < n, F.array(F.array_join(F.slice(f"{c.OWN}all", last + 1, n - last), "\n"))).otherwise(F.array().cast("array<string>"))
    pieces = F.concat(F.transform(F.filter(F.arrays_zip(before.alias("b"), starts.alias("s")), lambda x: x["s"]), lambda x: x["b"]), tail)
    d = d.withColumn(f"{c.OWN}all", lines)
    d = d.withColumns({f"{c.OWN}lines": F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long"), f"{c.OWN}removed_lines": F.coalesce(F.aggregate(own, F.lit(0), lambda a, g: a + g["stop"] - g["start"]), F.lit(0)).cast("long"), text_col: F.when(F.col(own).isNull(), F.col(text_col)).otherwise(F.array_join(pieces, "\n"))})
    return d.select(*docs.columns, f"{c.OWN}lines", f"{c.OWN}removed_lines")


def op9_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(c.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col(f"{c.OWN}lines").alias("n_lines"), F.col(f"{c.OWN}removed_lines").alias("n_removed_lines"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op9_line_chunk_dedup": f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS line, len(string_split(text, chr(10))) AS n
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines
), ends AS (
  SELECT *, (h + 31 * coalesce(lag(h) OVER w, 0)) % {MEAN_LINES} = 0 OR pos = n - 1 AS ends FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM ends
), chunks AS (
  SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY pos) AS body, count(*) AS m FROM numbered GROUP BY ALL HAVING count(*) > 1
), gone AS (
  SELECT doc_id, chunk FROM chunks QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) > 1
), kept AS (
  SELECT n.doc_id, string_agg(CASE WHEN g.chunk IS NULL THEN line END, chr(10) ORDER BY pos) AS text, count(*) AS n_lines, count(g.chunk) AS n_removed_lines
  FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.chunk = n.chunk GROUP BY n.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed_lines, 0)::BIGINT AS n_removed_lines, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
}
