"""Sinks: JSON documents, download manifests, the audit log, the provenance bundle."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import citations

#: Columns of a download manifest, in order.
DOWNLOAD_COLUMNS = ("id", "title", "url", "role", "status", "filename", "content_type", "bytes", "reason", "input_file")


def json_documents(df: DataFrame, path: str, key: str) -> None:
    """SK1: one JSON document a row, in a folder for each value of `key`; absent where null."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != key]))
    df.select(F.col(key), body.alias("value")).write.partitionBy(key).mode("overwrite").text(path)


def download_manifest(rows: DataFrame, path: str) -> None:
    """SK2: as JSON and as CSV with a header; missing values are empty. A byte-order mark begins the header of the CSV."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DOWNLOAD_COLUMNS]
    rows.select(*blank).write.mode("overwrite").json(f"{path}/json")
    marked = [x.alias("\ufeff" + c if c == DOWNLOAD_COLUMNS[0] else c) for x, c in zip(blank, DOWNLOAD_COLUMNS, strict=True)]
    rows.select(*marked).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{path}/csv")


def audit_log(rows: DataFrame, generated_at: str, policy: str) -> DataFrame:
    """SK3: one JSON document of all entries of each input file; blocked ones are kept."""
    entry = F.struct("id", "url", "status", "reason")
    head = [F.lit(generated_at).alias("generated_at"), F.lit("attesta").alias("tool"), F.lit(policy).alias("policy")]
    return rows.groupBy("input_file").agg(F.sort_array(F.collect_list(entry)).alias("entries")).select("input_file", F.to_json(F.struct(*head, "entries")).alias("value"))


def _file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def commit_bundles(reports: DataFrame, path: str, run: str) -> None:
    """SK8: the reports (case_key, report, json) of one run. They are written beside what is there, and count once their marker is written.

    A run that is given again replaces what it wrote before; one that breaks off leaves the former bundles as they were.
    """
    spark = reports.sparkSession
    marker = f"{path}/commits/{run}"
    fs, p = _file_system(spark, marker)
    fs.delete(p, True)
    reports.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{path}/runs/{run}")
    cases = spark.read.parquet(f"{path}/runs/{run}").agg(F.count_distinct("case_key").alias("cases"))
    cases.coalesce(1).write.mode("overwrite").json(marker)


def committed_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(case_key, report, json, run): of each case the reports of its last committed run, by the runs' names in order."""
    fs, p = _file_system(spark, f"{path}/commits")
    runs = sorted(x.getPath().getName() for x in fs.listStatus(p) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
    if not runs:
        raise FileNotFoundError(f"no committed run in {path}")
    rows = spark.read.parquet(*[f"{path}/runs/{x}" for x in runs])
    last = rows.groupBy("case_key").agg(F.max("run").alias("run"))
    return rows.join(last, ["case_key", "run"]).select("case_key", "report", "json", "run")


def finished_drafts(drafts: DataFrame, path: str) -> DataFrame:
    """SK6: finished texts with their problems, written even where there are some; returns (doc_id, valid, problems) as written.

    A draft without a reference section has no finished text and isn't valid.
    """
    done = citations.finished(drafts).select("doc_id", "final")
    problems = citations.final_problems(done.where(F.col("final").isNotNull())).groupBy("doc_id").agg(F.sort_array(F.collect_list("problem")).alias("problems"))
    out = done.join(problems, "doc_id", "left").withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))
    out = out.withColumn("valid", F.col("final").isNotNull() & (F.size("problems") == 0))
    out.write.mode("overwrite").parquet(path)
    return drafts.sparkSession.read.schema(out.schema).parquet(path).select("doc_id", "valid", "problems")
