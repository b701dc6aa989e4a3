"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition used by every operator: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Prefix of the columns that operators add for themselves; input columns of any other name cannot clash.
OWN = "__attesta_"

_written: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="attesta-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attesta-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._attesta_path = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Deletes tables made by `written` that no later step reads."""
    for df in frames:
        path = getattr(df, "_attesta_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


def sized_broadcast(df: DataFrame, most_rows: int, row_bytes: Column | None = None, most_bytes: int = 32 << 20) -> DataFrame:
    """`df` (written before) as the broadcast side of a join if it has few rows; else the join shuffles.

    Rows of no fixed size give theirs as `row_bytes`; their sum is held to `most_bytes`.
    """
    n, size = df.agg(F.count("*"), F.sum(F.lit(0) if row_bytes is None else row_bytes)).first()
    return F.broadcast(df) if n <= most_rows and (size or 0) <= most_bytes else df


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """256-bit content key of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))

