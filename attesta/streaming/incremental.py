"""Streams: claims that change are checked again, files that come again are left out.

The batch operators are used as they are: each micro-batch names what changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from attesta.operators import claims as op


def recheck(changes: DataFrame, graph: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], out: str, checkpoint: str, mode: str = "balanced") -> StreamingQuery:
    """Checks the claims that a stream of changes (claim_id) names; each batch is written once, under its number.

    `graph` gives claims, sources and evidence as they are when the batch runs. Writing a batch again replaces it, so that a
    restart repeats nothing.
    """

    def check(batch: DataFrame, number: int) -> None:
        claims, sources, evidence = graph()
        op.recheck(claims, sources, evidence, batch, mode).select("claim_id", "passed", "reasons", "score", "grade").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changes.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_files(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of files (md5, arrived, ...) without those whose content came within `delay` before."""
    return files.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["md5"])
