"""Distributed ranks and prefix sums over hot groups, in built-in operators only.

A plain ``row_number() over (partition by g)`` puts a whole group into one task. Here the sort
key is first cut into ``8 x spark.sql.shuffle.partitions`` buckets that follow its order; sums
of buckets are small, their running totals give each bucket's offset, and only rows of one
(group, bucket) meet in a window. Keys are uniform hashes or ranks, so buckets are even however
large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import named


def n_buckets(spark: SparkSession) -> int:
    """Buckets a group is cut into; follows the cluster's own partition count."""
    return 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit_hash(*cols: Column) -> Column:
    """Uniform double in (0, 1) from a 64-bit hash of the columns, reproducible between runs.

    Takes 52 bits, so the result is never 0 or 1."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") + 0.5) / F.lit(float(2**52))


def prefix(df: DataFrame, by: list[str], bucket: str, order: list[Column], weight: Column, out: str, total: str, per_group: DataFrame | None = None) -> DataFrame:
    """Adds ``out``, the sum of ``weight`` over the rows of the same ``by`` that come before or
    at the row in the order (bucket, *order), and ``total``, the sum over all rows of ``by``.

    ``bucket`` must grow with the order; no column of ``by`` may be null. Columns of ``per_group``,
    one row for each group, come along with the offsets, which are few."""
    keys = [*by, bucket]
    df = df.withColumn("_w", weight)
    sums = df.groupBy(*keys).agg(F.sum("_w").alias("_bw"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_bw").over(before), F.lit(0)).alias("_off"), F.sum("_bw").over(Window.partitionBy(*by)).alias(total))
    if per_group is not None:
        offsets = offsets.join(per_group, by)
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn("_in", F.sum("_w").over(inner))
    return ranked.join(offsets, keys).withColumn(out, F.col("_off") + F.col("_in")).drop("_w", "_in", "_off")


def attach(df: DataFrame, by: list[str], bucket: str, per_group: DataFrame) -> DataFrame:
    """Adds the columns of ``per_group``, one row for each group, by way of the buckets, so that
    a hot group is spread over its buckets in the join."""
    keys = [*by, bucket]
    return df.join(df.select(*keys).distinct().join(per_group, by), keys)


def row_key(df: DataFrame) -> Column:
    """Hash of a whole row."""
    plain = lambda f: F.map_entries(named(f.name)) if isinstance(f.dataType, T.MapType) else named(f.name)
    return F.xxhash64(*[plain(f) for f in df.schema.fields])


def carry_back(wide: DataFrame, narrow: DataFrame, cols: list[str]) -> DataFrame:
    """The columns of ``wide`` as w_0, w_1, ... with ``cols`` of ``narrow``, which has one row with
    ``_key`` = row_key for every row of ``wide``, so that texts are moved once. Rows with equal
    keys are numbered on both sides; they are alike, so it does not matter which gets which."""
    order = Window.partitionBy("_key")
    left = wide.select(*[named(c).alias(f"w_{i}") for i, c in enumerate(wide.columns)], row_key(wide).alias("_key")).withColumn("_nth", F.row_number().over(order.orderBy("_key")))
    right = narrow.select("_key", *cols).withColumn("_nth", F.row_number().over(order.orderBy(*cols)))
    return left.join(right, ["_key", "_nth"]).drop("_key", "_nth")


def named_back(joined: DataFrame, names: list[str], cols: list[str]) -> DataFrame:
    """The columns of carry_back under their own names; one that is called as one of ``cols``
    makes way for it."""
    return joined.select(*[F.col(f"w_{i}").alias(c) for i, c in enumerate(names) if c not in cols], *cols)
