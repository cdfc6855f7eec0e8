"""Streaming forms of batch operators (extensions): each gives the batch result on its input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import records as rec


def usage_by_window(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, kind, n_calls, total by tumbling windows of calls (ts, kind, value). On a stream,
    rows later than ``late`` behind the newest are dropped; on a batch, none."""
    if calls.isStreaming:
        calls = calls.withWatermark("ts", late)
    grouped = calls.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n_calls"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "kind", "n_calls", "total")


def merge_into(path: str):
    """A function for foreachBatch that keeps the records of all batches at ``path`` and, beside
    them, their resolution. Positions decide the order, so the batches' order does not matter;
    a batch that comes again replaces itself."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/in/epoch={epoch}")
        rec.merge(spark.read.parquet(f"{path}/in")).write.mode("overwrite").parquet(f"{path}/merged")

    return run
