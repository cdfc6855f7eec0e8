"""Tables written between steps of an operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import EngineError


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame as a Parquet table in spark.checkpoint.dir."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, which all executors share. Only on one machine may that
    be unset; a folder of this machine does then."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("no_shared_folder", "set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base}/tessera-{uuid.uuid4().hex}/{name}"
