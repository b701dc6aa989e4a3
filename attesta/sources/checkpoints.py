"""Cutting lineage between steps of an iteration."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_stored: list[tuple[SparkSession, str]] = []


def _set_folder(df: DataFrame) -> None:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="attesta-"))


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the folder that `spark.checkpoint.dir` names, where it survives lost executors.

    Only a local session without that setting gets a folder of its own.
    """
    _set_folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as compressed columns, for large tables of which later steps read some columns each; deleted when the session ends."""
    _set_folder(df)
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _stored.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _delete_all() -> None:
    for spark, path in _stored:
        with contextlib.suppress(Exception):  # the session has ended; the folder's owner cleans up
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
