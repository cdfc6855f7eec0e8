"""Places of rows in long ordered groups, without a window over a group.

Rows are dealt out by ranges of (group, order), whose borders Spark samples, so that a group that holds
most rows is spread over many ranges. A row's place is its place in the range plus the sizes of the
group's ranges before it, of which there are no more than partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import written


def dealt_by_range(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` with _range, a number that does not fall in the order of (by, order); written, so that
    ranges stay as they are."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id()), "ranges")


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Whether the columns are equal, nulls being equal to each other."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def ranked(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """Adds ``out``, the place of each row (from 1) in its group of ``by``; a null makes a group, and
    rows that are equal in the order come in any."""
    dealt = dealt_by_range(df, by, order)
    sizes = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = dealt.withColumn(out, F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    joined = own.join(offsets, same(own, offsets, [*by, "_range"]))
    return joined.select(*[own[c] for c in df.columns if c != out], (own[out] + offsets["_before"]).cast("long").alias(out))
