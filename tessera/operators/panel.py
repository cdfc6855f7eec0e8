"""Panel data: filters, profiles, readiness, trajectories and event time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EngineError
from tessera.functions.formula import resolve
from tessera.functions.numbers import missing, numeric, present

#: Names that are taken for panel keys, most telling first.
UNIT_NAMES = ("firm_id", "unit", "symbol", "company_id", "id")
TIME_NAMES = ("year", "time", "period")


def condition(df: DataFrame, field: str, op: str, value: object) -> Column:
    """A sample filter; never NULL. Missing values pass ``ne`` only."""
    if field not in df.columns:
        raise EngineError("missing_field", f"no field {field} to filter by")
    col = present(df, field)
    if op == "in":
        if not isinstance(value, (list, tuple)):
            raise EngineError("invalid_filter", f"{field}: 'in' takes a list")
        test = col.isin(list(value)) if value else F.lit(False)
    elif op == "ne":
        return ~col.eqNullSafe(F.lit(value))
    elif op in ("eq", "ge", "le"):
        test = {"eq": col == F.lit(value), "ge": col >= F.lit(value), "le": col <= F.lit(value)}[op]
    else:
        raise EngineError("invalid_filter", f"unknown comparison {op}")
    return F.coalesce(test, F.lit(False))


def apply_filters(df: DataFrame, rules: list[tuple[str, str, object]]) -> DataFrame:
    tests = [condition(df, *r) for r in rules]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def drop_missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_total, n_valid, dropped, and invalid_<column> for each."""
    bad = {c: numeric(df, c).isNull() if isinstance(df.schema[c].dataType, T.NumericType) else missing(df, c) for c in columns}
    out = [F.count("*").alias("n_total"), F.count_if(~reduce(Column.__or__, bad.values())).alias("n_valid"), F.count_if(reduce(Column.__or__, bad.values())).alias("dropped")]
    return df.agg(*out, *[F.count_if(b).alias(f"invalid_{c}") for c, b in bad.items()])


def profile(df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """name, label, type, missing_rate, unique_count, min, max of each column, in one pass.

    Distinct values are counted exactly; min and max are of finite values of numeric columns."""
    if not df.columns:
        raise EngineError("invalid_columns", "nothing to profile")
    facts = []
    for i, f in enumerate(df.schema.fields):
        number = numeric(df, f.name) if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        facts += [F.avg(missing(df, f.name).cast("double")).alias(f"m{i}"), F.count_distinct(present(df, f.name)).alias(f"u{i}"), F.min(number).alias(f"a{i}"), F.max(number).alias(f"b{i}")]
    rows = [F.struct(F.lit(f.name).alias("name"), F.lit((labels or {}).get(f.name, "")).alias("label"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"m{i}").alias("missing_rate"), F.col(f"u{i}").alias("unique_count"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max")) for i, f in enumerate(df.schema.fields)]
    return df.agg(*facts).select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def detect_keys(columns: list[str]) -> tuple[str | None, str | None]:
    lower = {c.lower(): c for c in columns}
    pick = lambda names: next((lower[n] for n in names if n in lower), None)
    return pick(UNIT_NAMES), pick(TIME_NAMES)


def panel_info(df: DataFrame, unit: str | None = None, time: str | None = None) -> DataFrame:
    """One row: unit, time, n_units, n_periods, duplicates, missing_keys, balanced, time_min,
    time_max. Rows with equal keys count as duplicates beyond the first, missing keys being equal
    to each other."""
    found = detect_keys(df.columns)
    unit, time = unit or found[0], time or found[1]
    if not unit or not time or unit == time or unit not in df.columns or time not in df.columns:
        raise EngineError("invalid_panel", "unit and time must be two different fields")
    u, t = present(df, unit), present(df, time)
    # counting by key first lets Spark combine before it shuffles, however hot a key is
    keys = df.groupBy(u.alias("u"), t.alias("t")).agg(F.count("*").alias("n"))
    facts = keys.agg(F.count_distinct("u").alias("n_units"), F.count_distinct("t").alias("n_periods"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("u").isNull() | F.col("t").isNull(), F.col("n"))), F.lit(0)).alias("missing_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min("t").cast("string").alias("time_min"), F.max("t").cast("string").alias("time_max"))
    balanced = (F.col("rows") == F.col("n_units") * F.col("n_periods")) & (F.col("duplicates") == 0) & (F.col("missing_keys") == 0)
    return facts.select(F.lit(unit).alias("unit"), F.lit(time).alias("time"), "n_units", "n_periods", "duplicates", "missing_keys", balanced.alias("balanced"), "time_min", "time_max")


def trajectories(df: DataFrame, unit: str, time: str, treatment: str) -> DataFrame:
    """unit, time, treatment of rows with both keys; treatment may be NULL."""
    for key in (unit, time):
        if key not in df.columns:
            raise EngineError("missing_field", f"no panel key {key}")
    out = df.select(present(df, unit).alias("unit"), numeric(df, time).alias("time"), resolve(df, treatment).alias("treatment"))
    return out.where("unit is not null and time is not null")


def duplicate_keys(df: DataFrame, unit: str, time: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(unit, time).agg(F.count("*").alias("n")).where("n > 1")


def _along(unit: str = "unit", time: str = "time") -> Window:
    return Window.partitionBy(unit).orderBy(time)


def reversals(paths: DataFrame) -> DataFrame:
    """unit, reversals (falls of treatment between successive periods), and n_missing."""
    step = F.col("treatment") - F.lag("treatment").over(_along())
    return paths.withColumn("step", step).groupBy("unit").agg(F.count_if(F.col("step") < 0).alias("reversals"), F.count_if(F.col("treatment").isNull()).alias("n_missing"))


def monotone_units(paths: DataFrame) -> DataFrame:
    """Units whose treatment never falls and is never missing."""
    return reversals(paths).where("reversals = 0 and n_missing = 0").select("unit")


def first_exposure(paths: DataFrame) -> DataFrame:
    """unit, first period with treatment 1 (units never treated are absent)."""
    return paths.where("treatment = 1").groupBy("unit").agg(F.min("time").alias("first"))


def cohort_sizes(paths: DataFrame) -> DataFrame:
    return first_exposure(paths).groupBy("first").agg(F.count("*").alias("n_units"))


def event_time(paths: DataFrame, low: int, high: int) -> DataFrame:
    """paths with first, relative time, and relative time clipped to the window; the last two are
    NULL for units never treated."""
    first = F.min(F.when(F.col("treatment") == 1, F.col("time"))).over(Window.partitionBy("unit"))
    out = paths.withColumn("first", first).withColumn("relative", F.col("time") - F.col("first"))
    return out.withColumn("clipped", F.when(F.col("relative").isNotNull(), F.least(F.greatest("relative", F.lit(float(low))), F.lit(float(high)))))


def pivot_trajectories(paths: DataFrame, periods: list[float]) -> DataFrame:
    """One row for each unit, a column d_<period> for each of the stated periods."""
    names = {p: f"d_{int(p) if float(p).is_integer() else p}" for p in periods}
    wide = paths.groupBy("unit").agg(*[F.max(F.when(F.col("time") == p, F.col("treatment"))).alias(n) for p, n in names.items()])
    return wide.select("unit", *names.values())


def sample_report(df: DataFrame, unit: str, time: str, treatment: str, outcome: str, others: list[str] = ()) -> DataFrame:
    """One row on whether a sample can be analysed: sizes, duplicates, exposure, monotony."""
    names = [unit, time, treatment, outcome, *others]
    clean = df.select(present(df, unit).alias("unit"), *[numeric(df, c).alias("time" if c == time else "treatment" if c == treatment else c) for c in names[1:]])
    valid = clean.dropna()
    total = df.agg(F.count("*").alias("n_total"))
    paths = valid.withColumn("step", F.col("treatment") - F.lag("treatment").over(_along()))
    by_unit = paths.groupBy("unit").agg(F.count("*").alias("n"), F.count_distinct("time").alias("periods"), F.max("treatment").alias("ever"), F.count_if(F.col("step") < 0).alias("falls"), F.count_if(~F.col("treatment").isin(0.0, 1.0)).alias("odd"))
    facts = by_unit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_valid"), F.count("*").alias("n_units"), F.coalesce(F.sum(F.col("n") - F.col("periods")), F.lit(0)).alias("duplicates"), F.count_if(F.col("ever") == 1).alias("treated"), F.count_if(F.col("ever") == 0).alias("control"), F.count_if(F.col("falls") == 0).alias("monotone"), F.coalesce(F.sum("falls"), F.lit(0)).alias("falls"), (F.coalesce(F.sum("odd"), F.lit(0)) == 0).alias("binary_treatment"))
    periods = valid.agg(F.count_distinct("time").alias("n_periods"))
    only = lambda c: F.when(F.col("binary_treatment"), F.col(c))
    return total.crossJoin(facts).crossJoin(periods).select("n_total", "n_valid", (F.col("n_total") - F.col("n_valid")).alias("dropped"), "n_units", "n_periods", "duplicates", "binary_treatment", only("treated").alias("treated_units"), only("control").alias("control_units"), only("monotone").alias("monotone_units"), only("falls").alias("reversal_transitions"))
