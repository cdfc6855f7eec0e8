"""Numeric coercion: whatever is not a finite number is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as numbers. The guard is needed because casts also take '1d' and '1.0f'.
NUMBER = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


def ieee(col: Column, kind: T.DataType) -> Column:
    """As double, keeping NaN and infinities; unreadable text is NULL."""
    if isinstance(kind, T.StringType):
        return F.when(col.rlike(NUMBER), F.trim(col).try_cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    return F.lit(None).cast("double")


def finite(col: Column) -> Column:
    """NULL for NaN and infinities of a double."""
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def numeric(df: DataFrame, name: str) -> Column:
    """A column of ``df`` as finite double or NULL."""
    return finite(ieee(F.col(name), df.schema[name].dataType))


def missing(df: DataFrame, name: str) -> Column:
    """Whether a value counts as missing: NULL, or NaN in a floating column."""
    col = F.col(name)
    return col.isNull() | F.isnan(col) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else col.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN as NULL."""
    return F.when(~missing(df, name), F.col(name))
