"""Catalog of panel and regression queries, each with its SQL where SQL can say the same."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.formula import formula
from tessera.operators import analysis, panel, permutation
from tessera.operators.fixed_effects import fit
from tessera.plans import engine, panels
from tessera.plans.panels import CUSTOMER_YEAR, NATION_YEAR, USER_DAY
from tessera.plans.spec import Check, Spec
from tessera.plans.sql_inference import fit_row, several, two_sided, unrolled, with_reach
from tessera.sources import files
from tessera.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


# -- tables ----------------------------------------------------------------------------------------

_NUM = "SELECT '{c}' AS name, '{t}' AS type, round(avg(({c} IS NULL)::INT)::DOUBLE, 9) AS missing_rate, count(DISTINCT {c})::BIGINT AS unique_count, min({c})::DOUBLE AS \"min\", max({c})::DOUBLE AS \"max\" FROM {f}"
_TEXT = "SELECT '{c}', '{t}', round(avg(({c} IS NULL)::INT)::DOUBLE, 9), count(DISTINCT {c})::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM {f}"
_PROFILED = {
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")],
}


@query(" UNION ALL ".join((_NUM if t in ("bigint", "int", "double") else _TEXT).format(c=c, t=t, f=f) for f, cs in _PROFILED.items() for c, t in cs))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the two largest tables."""
    prof = panel.profile(table(spark, sf_dir, "lineitem")).unionByName(panel.profile(table(spark, sf_dir, "orders")))
    return prof.select("name", F.regexp_replace("type", "timestamp_ntz", "timestamp").alias("type"), F.round("missing_rate", 9).alias("missing_rate"), "unique_count", "min", "max")


@query(f"""WITH {CUSTOMER_YEAR}, k AS (SELECT unit, t, count(*) AS n FROM cy GROUP BY 1, 2)
SELECT 'unit' AS unit, 't' AS time, count(DISTINCT unit)::BIGINT AS n_units, count(DISTINCT t)::BIGINT AS n_periods, sum(n - 1)::BIGINT AS duplicates, 0::BIGINT AS missing_keys,
 (sum(n) = count(DISTINCT unit) * count(DISTINCT t) AND sum(n - 1) = 0) AS balanced, min(t)::VARCHAR AS time_min, max(t)::VARCHAR AS time_max FROM k""")
def panel_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.panel_info(panels.customer_year(spark, sf_dir), "unit", "t").withColumn("missing_keys", F.col("missing_keys").cast("long"))


@query("SELECT l_orderkey, l_suppkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def panel_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "conversations", "benchmark", "pages"]
_KIND = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' ELSE column_type END"


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", (row_number() OVER () - 1)::INT AS seq, column_name AS name, {_KIND} AS type FROM (DESCRIBE SELECT * FROM {n})" for n in _TABLES))
def file_schema_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [files.inspect(spark, f"{sf_dir}/{n}.parquet").select(F.lit(n).alias("table"), "seq", "name", F.regexp_replace("type", "timestamp_ntz", "timestamp").alias("type")) for n in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- formulas and filters --------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(ln(1.0::DOUBLE + (l_quantity + l_extendedprice)), 9) AS value FROM lineitem")
def formula_log1p_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", F.round(formula(d, "log1p(l_quantity + l_extendedprice)"), 9).alias("value"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_extendedprice / l_discount, 6) END AS value FROM lineitem")
def formula_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", F.round(formula(d, "l_extendedprice / l_discount"), 6).alias("value"))


@query("SELECT p_partkey, round(-p_retailprice + 2.0::DOUBLE * p_size, 6) AS value FROM part")
def formula_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part")
    return d.select("p_partkey", F.round(formula(d, "-p_retailprice + 2 * +p_size"), 6).alias("value"))


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the status missing on every seventh key."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"), "o_totalprice")


_HOLED = "WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status, o_totalprice FROM orders) SELECT o_orderkey, status, o_totalprice FROM h WHERE "


def _filtered(spark: SparkSession, sf_dir: str, field: str, op: str, value: object) -> DataFrame:
    return panel.apply_filters(_holed(spark, sf_dir), [(field, op, value)])


@query(_HOLED + "status = 'F'")
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "status", "eq", "F")


@query(_HOLED + "status IS DISTINCT FROM 'F'")
def filter_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "status", "ne", "F")


@query(_HOLED + "o_totalprice >= 100000")
def filter_ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "o_totalprice", "ge", 100000.0)


@query(_HOLED + "o_totalprice <= 100000")
def filter_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "o_totalprice", "le", 100000.0)


@query(_HOLED + "status IN ('O', 'P')")
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "status", "in", ["O", "P"])


@query(_HOLED.split(" SELECT o_orderkey, status")[0] + " SELECT count(*)::BIGINT AS n_total, count(status)::BIGINT AS n_valid, (count(*) - count(status))::BIGINT AS dropped, (count(*) - count(status))::BIGINT AS invalid_status, 0::BIGINT AS invalid_o_totalprice FROM h")
def drop_missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.drop_missing_report(_holed(spark, sf_dir), ["status", "o_totalprice"])


# -- trajectories ----------------------------------------------------------------------------------

_PATHS = f"WITH {CUSTOMER_YEAR}, p AS (SELECT unit, t, d, a, d - lag(d) OVER (PARTITION BY unit ORDER BY t) AS step FROM cy), f AS (SELECT unit, min(t)::DOUBLE AS first FROM cy WHERE d = 1 GROUP BY unit)"


def _paths(spark: SparkSession, sf_dir: str, treatment: str = "d") -> DataFrame:
    return panel.trajectories(panels.customer_year(spark, sf_dir), "unit", "t", treatment)


@query(f"""{_PATHS}, u AS (SELECT unit, max(d) AS ever, count(*) FILTER (step < 0) AS falls FROM p GROUP BY unit)
SELECT (SELECT count(*) FROM cy)::BIGINT AS n_total, (SELECT count(*) FROM cy)::BIGINT AS n_valid, 0::BIGINT AS dropped, count(*)::BIGINT AS n_units, (SELECT count(DISTINCT t) FROM cy)::BIGINT AS n_periods, 0::BIGINT AS duplicates, true AS binary_treatment,
 (count(*) FILTER (ever = 1))::BIGINT AS treated_units, (count(*) FILTER (ever = 0))::BIGINT AS control_units, (count(*) FILTER (falls = 0))::BIGINT AS monotone_units, sum(falls)::BIGINT AS reversal_transitions FROM u""")
def sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.sample_report(panels.customer_year(spark, sf_dir), "unit", "t", "d", "y", ["x"])


@query(f"{_PATHS} SELECT unit, first FROM f")
def first_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.first_exposure(_paths(spark, sf_dir))


@query(f"{_PATHS} SELECT first, count(*)::BIGINT AS n_units FROM f GROUP BY first")
def cohort_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.cohort_sizes(_paths(spark, sf_dir))


@query(f"{_PATHS} SELECT unit, (count(*) FILTER (step < 0))::BIGINT AS reversals, 0::BIGINT AS n_missing FROM p GROUP BY unit")
def reversal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.reversals(_paths(spark, sf_dir))


@query(f"{_PATHS} SELECT unit FROM p GROUP BY unit HAVING count(*) FILTER (step < 0) = 0")
def monotone_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.monotone_units(_paths(spark, sf_dir))


@query(f"""{_PATHS} SELECT cy.unit, t::DOUBLE AS time, d AS treatment, first, t - first AS relative,
 CASE WHEN first IS NOT NULL THEN least(greatest(t - first, -3.0::DOUBLE), 3.0::DOUBLE) END AS clipped FROM cy LEFT JOIN f USING (unit)""")
def event_time_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.event_time(_paths(spark, sf_dir), -3, 3)


_YEARS = range(1995, 2002)


@query(f"WITH {CUSTOMER_YEAR} SELECT unit, " + ", ".join(f"max(CASE WHEN t = {y} THEN d END) AS d_{y}" for y in _YEARS) + " FROM cy GROUP BY unit")
def trajectory_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.pivot_trajectories(_paths(spark, sf_dir), [float(y) for y in _YEARS])


@query(f"{_PATHS} SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT unit FROM p GROUP BY unit HAVING count(*) FILTER (step < 0) = 0)")
def semi_join_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = panel.monotone_units(_paths(spark, sf_dir)).withColumnRenamed("unit", "o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(units, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, year(o_orderdate)::BIGINT AS year FROM orders WHERE year(o_orderdate) NOT IN (1996, 2001)")
def anti_join_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))
    return d.where(~F.col("year").isin(1996, 2001))


# -- regressions -----------------------------------------------------------------------------------

_FIT = "name string, coef double, se double, t double, p double, ci_low double, ci_high double, n_obs long, n_clusters long"


def _rounded(name: str, found: dict) -> dict:
    """Bounds and p go through a quantile, which is found by other means in SQL."""
    return {"name": name} | {k: round(v, 8 if k in ("p", "ci_low", "ci_high") else 9) if isinstance(v, float) else v for k, v in found.items()}


def _fit(spark: SparkSession, data: DataFrame, regressors: list[str], effects: list[str], cluster: str = "unit") -> DataFrame:
    d = data.select("unit", F.col("t").alias("time"), F.col(cluster).alias("cluster"), "y", *regressors).persist()
    try:
        found = fit(d, regressors, effects)
        rows = [_rounded(n, found.summary(n)) for n in regressors]
    finally:
        d.unpersist()
    return _rows(spark, rows, _FIT)


def _fit_sql(base: str, source: str, mean: str, k: str, cluster: str = "unit") -> str:
    """One regressor x on y with both demeaned by ``mean``; k counts parameters."""
    return f"""WITH {base}, w AS (SELECT *, {mean.format(v='y')} AS yw, {mean.format(v='x')} AS xw FROM {source}),
{several('w', ['x'], k, cluster)}, {fit_row('r', 'x')}"""


@query(_fit_sql(NATION_YEAR, "ny", "{v} - avg({v}) OVER ()", "2"))
def fe_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, panels.nation_year(spark, sf_dir), ["x"], [])


@query(_fit_sql(NATION_YEAR, "ny", "{v} - avg({v}) OVER (PARTITION BY unit)", "1 + count(DISTINCT unit)"))
def fe_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, panels.nation_year(spark, sf_dir), ["x"], ["unit"])


@query(_fit_sql(NATION_YEAR, "ny", "{v} - avg({v}) OVER (PARTITION BY t)", "1 + count(DISTINCT t)"))
def fe_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, panels.nation_year(spark, sf_dir), ["x"], ["time"])


_TWO_WAY = "{v} - avg({v}) OVER (PARTITION BY unit) - avg({v}) OVER (PARTITION BY t) + avg({v}) OVER ()"
_TWO_K = "count(DISTINCT unit) + count(DISTINCT t)"


@query(_fit_sql(NATION_YEAR, "ny", _TWO_WAY, _TWO_K))
def fe_twoway_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, panels.nation_year(spark, sf_dir), ["x"], ["unit", "time"])


@query(_fit_sql(NATION_YEAR, "ny", _TWO_WAY, _TWO_K, "region"))
def fe_cluster_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, panels.nation_year(spark, sf_dir), ["x"], ["unit", "time"], "region")


@query(f"WITH {USER_DAY}, {unrolled('ud', 15)}, {several('w15', ['x'], _TWO_K)}, {fit_row('r', 'x')}")
def fe_twoway_unbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, panels.user_day(spark, sf_dir), ["x"], ["unit", "time"])


def _spec(**more) -> Spec:
    return Spec(**{"unit": "unit", "time": "t", "outcome": "y", "treatment": "a", "method_family": "policy_causal", "bins": (-3, -2, 0, 1, 2, 3)} | more)


_EVENT = "k long, coef double, se double, p double, ci_low double, ci_high double"


_BINS = (-3, -2, 0, 1, 2, 3)
_EVENT_SQL = f"""WITH {CUSTOMER_YEAR}, ep AS (SELECT unit, t, a - lag(a) OVER (PARTITION BY unit ORDER BY t) AS step FROM cy), eg AS (SELECT unit FROM ep GROUP BY unit HAVING count(*) FILTER (step < 0) = 0),
ef AS (SELECT unit, min(t) AS first FROM cy WHERE a = 1 GROUP BY unit),
ev AS (SELECT cy.unit, t, y, {', '.join(f'coalesce((least(greatest(t - first, -3), 3) = {k})::INT::DOUBLE, 0.0::DOUBLE) AS e{i}' for i, k in enumerate(_BINS))} FROM cy JOIN eg USING (unit) LEFT JOIN ef USING (unit)),
{unrolled('ev', 30, ('y', *(f'e{i}' for i in range(len(_BINS)))), 'z')}, {several('z30', [f'e{i}' for i in range(len(_BINS))], f'{_TWO_K} + {len(_BINS) - 1}')}"""
_EVENT_ROWS, _EVENT_LAST = with_reach("(" + " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, b{i} AS coef, sqrt(v{i}_{i}) AS se, nu FROM r" for i, k in enumerate(_BINS)) + ")")


@query(f"{_EVENT_SQL}, {_EVENT_ROWS} SELECT k, round(coef, 7) AS coef, round(se, 7) AS se, round({two_sided('(coef / se)', 'nu')}, 7) AS p, round(coef - tq * se, 7) AS ci_low, round(coef + tq * se, 7) AS ci_high FROM {_EVENT_LAST}")
def event_study_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = analysis.event_study(_spec(), panels.customer_year(spark, sf_dir))["terms"]
    return _rows(spark, [{k: round(v, 7) if isinstance(v, float) else v for k, v in x.items()} for x in terms], _EVENT)


# with two restrictions the tail of F has a closed form
@query(f"""{_EVENT_SQL}, f AS (SELECT (b0 * (v1_1 * b0 - v0_1 * b1) + b1 * (v0_0 * b1 - v0_1 * b0)) / (v0_0 * v1_1 - v0_1 * v0_1) / 2 AS stat, nu FROM r)
SELECT round(stat, 6) AS stat, round(pow(1 + 2 * stat / nu, -nu / 2.0), 7) AS p, 2::BIGINT AS df, nu AS df_denom FROM f""")
def pretrend_wald(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = analysis.event_study(_spec(), panels.customer_year(spark, sf_dir))["pretrend_wald"]
    return _rows(spark, [w | {"stat": w["stat"] and round(w["stat"], 6), "p": w["p"] and round(w["p"], 7)}], "stat double, p double, df long, df_denom long")


def _estimated(spark: SparkSession, spec: Spec, raw: DataFrame) -> DataFrame:
    e = analysis.estimate(spec, raw)
    return _rows(spark, [_rounded("x", e)], _FIT)


def _robust_sql(where: str = "true", y: str = "y", units: str = "true") -> str:
    base = f"{CUSTOMER_YEAR}, p AS (SELECT unit, t, d - lag(d) OVER (PARTITION BY unit ORDER BY t) AS step FROM cy), good AS (SELECT unit FROM p GROUP BY unit HAVING count(*) FILTER (step < 0) = 0)"
    return f"WITH {base}, z AS (SELECT unit, t, {y} AS y, d AS x FROM cy WHERE {where} AND {units}), {unrolled('z', 30)}, {several('w30', ['x'], _TWO_K)}, {fit_row('r', 'x')}"


def _robust(spark: SparkSession, sf_dir: str, check: Check, **more) -> DataFrame:
    raw = panels.customer_year(spark, sf_dir)
    return _estimated(spark, *analysis.rewritten(_spec(treatment="d", **more), check, raw))


@query(_robust_sql())
def main_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimated(spark, _spec(treatment="d"), panels.customer_year(spark, sf_dir))


@query(_robust_sql())
def robust_drop_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robust(spark, sf_dir, Check("1", "drop_controls"), controls=("log1p(n)",))


@query(_robust_sql(where="t <> 2001"))
def robust_exclude_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robust(spark, sf_dir, Check("2", "exclude_years", {"years": [2001]}))


@query(_robust_sql(units="unit IN (SELECT unit FROM good)"))
def robust_monotone_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robust(spark, sf_dir, Check("3", "monotone_only"))


@query(_robust_sql(y="y - ln(n)"))
def robust_alt_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robust(spark, sf_dir, Check("4", "alt_outcome", {"outcome": "y - log(n)"}))


@query(f"WITH {CUSTOMER_YEAR}, z AS (SELECT unit, t, y, d, x AS c FROM cy), {unrolled('z', 30, ('y', 'd', 'c'))}, {several('w30', ['d', 'c'], _TWO_K + ' + 1')}, {fit_row('r', 'x')}")
def robust_add_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robust(spark, sf_dir, Check("5", "add_controls", {"controls": ["log1p(n)"]}))


_INTERACTION = ("d", "x", "z")


@query(f"""WITH {NATION_YEAR}, q AS (SELECT *, d * x AS z FROM ny), w AS (SELECT *, {', '.join(f'{_TWO_WAY.format(v=v)} AS {v}w' for v in ('y', *_INTERACTION))} FROM q),
{several('w', list(_INTERACTION), _TWO_K + ' + 2')}, {fit_row('r', 'interaction', 'b2', 'v2_2')}""")
def interaction_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _spec(treatment="d", moderator="x", method_family="mechanism_boundary")
    e = analysis.estimate(spec, panels.nation_year(spark, sf_dir))
    return _rows(spark, [_rounded(e["target"], e)], _FIT)


# -- permutation -----------------------------------------------------------------------------------

_DRAWS = 99


def _md5_draws(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """draw (0: observed), coef: units take each other's paths in the order of a digest of draw
    and unit, instead of that of a seeded generator. On a balanced panel of nations."""
    spec, raw = _spec(**more), panels.nation_year(spark, sf_dir).persist()
    try:
        sample = permutation.sample_of(*analysis.permutation_sample(spec, raw), list(spec.fe), bool(spec.moderator))
    finally:
        raw.unpersist()
    digest = F.md5(F.concat_ws("-", F.lit("42"), F.col("draw").cast("string"), F.col("unit").cast("string")).cast("binary"))
    keyed = sample.index.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_DRAWS).cast("long")))).withColumn("key", F.when(F.col("draw") == 0, F.lit("")).otherwise(digest))
    orders = keyed.groupBy("draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "at"))), lambda x: x["at"].cast("int")).alias("donors"))  # 25 nations a draw
    return permutation.coefficients(sample, orders, permutation.listed_orders)


_MD5 = f"""WITH {NATION_YEAR}, u AS (SELECT DISTINCT unit FROM ny), dr AS (SELECT range AS draw FROM range({_DRAWS + 1})),
dn AS (SELECT draw, unit AS donor, row_number() OVER (PARTITION BY draw ORDER BY CASE WHEN draw = 0 THEN lpad(unit::VARCHAR, 40, '0') ELSE md5('42-' || draw || '-' || unit) END) AS place FROM dr, u),
ow AS (SELECT draw, unit, row_number() OVER (PARTITION BY draw ORDER BY unit) AS place FROM dr, u),
bo AS (SELECT ow.draw, ow.unit, x.t, x.y, z.a, x.x AS m, z.a * x.x AS z FROM ow JOIN dn ON ow.draw = dn.draw AND ow.place = dn.place JOIN ny x ON x.unit = ow.unit JOIN ny z ON z.unit = dn.donor AND z.t = x.t),
fr AS (SELECT draw, {', '.join(f'{v} - avg({v}) OVER (PARTITION BY draw, unit) - avg({v}) OVER (PARTITION BY draw, t) + avg({v}) OVER (PARTITION BY draw) AS {v}w' for v in ('y', 'a', 'm', 'z'))} FROM bo),
co AS (SELECT draw::BIGINT AS draw, sum(yw * aw) / sum(aw * aw) AS coef FROM fr GROUP BY draw)"""


@query(f"{_MD5} SELECT draw, round(coef, 8) AS coef FROM co")
def permutation_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _md5_draws(spark, sf_dir).select("draw", F.round("coef", 8).alias("coef"))


# by Cramer's rule
@query(f"""{_MD5}, pr AS (SELECT draw::BIGINT AS draw, sum(aw * aw) AS aa, sum(aw * mw) AS am, sum(mw * mw) AS mm, sum(aw * zw) AS az, sum(mw * zw) AS mz, sum(zw * zw) AS zz, sum(yw * aw) AS ya, sum(yw * mw) AS ym, sum(yw * zw) AS yz FROM fr GROUP BY draw)
SELECT draw, round((aa * (mm * yz - ym * mz) - am * (am * yz - ym * az) + ya * (am * mz - mm * az)) / (aa * (mm * zz - mz * mz) - am * (am * zz - mz * az) + az * (am * mz - mm * az)), 7) AS coef FROM pr""")
def permutation_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = _md5_draws(spark, sf_dir, method_family="mechanism_boundary", moderator="x")
    return draws.select("draw", F.round("coef", 7).alias("coef"))


@query(f"""{_MD5}, o AS (SELECT coef AS observed FROM co WHERE draw = 0)
SELECT round((1 + count(*) FILTER (abs(coef) >= abs(observed))) / (count(*) + 1), 9) AS p, count(*)::BIGINT AS n, round(avg(coef), 8) AS mean, round(stddev_pop(coef), 8) AS std,
 round(quantile_cont(coef::DOUBLE, 0.025), 8) AS q025, round(quantile_cont(coef::DOUBLE, 0.975), 8) AS q975 FROM co, o WHERE draw > 0""")
def permutation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = _md5_draws(spark, sf_dir)
    observed = draws.where("draw = 0").first()["coef"]
    s = analysis.permutation_summary(float(observed), draws.where("draw > 0"))
    return s.select(F.round("p", 9).alias("p"), "n", *[F.round(c, 8).alias(c) for c in ("mean", "std", "q025", "q975")])


@query(f"""{_MD5}, e AS (SELECT min(coef) AS lo, max(coef) AS hi FROM co WHERE draw > 0)
SELECT least(24, greatest(0, floor((coef - lo) / ((hi - lo) / 25))))::INT AS bin, count(*)::BIGINT AS n FROM co, e WHERE draw > 0 GROUP BY 1""")
def permutation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.histogram(_md5_draws(spark, sf_dir).where("draw > 0"), "coef", 25)


@query()
def permutation_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = panels.customer_year(spark, sf_dir).persist()
    try:
        observed, draws = analysis.permutation_draws(_spec(permutation_n=199), raw)
    finally:
        raw.unpersist()
    return analysis.permutation_summary(observed, draws)


_AGAIN = {"main": (NATION_YEAR, "ny", ["d"]), "r1": (NATION_YEAR, "(SELECT * FROM ny WHERE t <> 2001)", ["d"]), "r2": (NATION_YEAR, "ny", ["d", "x"])}


@query(f"WITH {NATION_YEAR}, " + ", ".join(f"{unrolled(source, 40, ('y', *xs), f'{i}z')}, {several(f'{i}z40', xs, f'{_TWO_K} + {len(xs) - 1}', name=i)}" for i, (_, source, xs) in _AGAIN.items()) + " " + " UNION ALL ".join(f"SELECT '{i}' AS id, 'consistent' AS status, 'reproduction' AS origin, round(b0, 7) AS coef, round(sqrt(v0_0), 7) AS se, n::BIGINT AS n_obs FROM {i}" for i in _AGAIN))
def reproduction_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed estimates, and whether they agree with those of the analysis."""
    raw = panels.nation_year(spark, sf_dir).persist()
    spec = replace(_spec(treatment="d"), robustness=(Check("r1", "exclude_years", {"years": [2001]}), Check("r2", "add_controls", {"controls": ["log1p(n)"]})))
    try:
        out = analysis.reproduce(spec, raw, analysis.estimate(spec, raw), analysis.robustness(spec, raw))
    finally:
        raw.unpersist()
    return _rows(spark, [r | {k: r[k] if r[k] is None else round(r[k], 7) for k in ("coef", "se")} for r in out["rows"]], "id string, status string, origin string, coef double, se double, n_obs long")


_RUN = {i: (base, source, ["a" if x == "d" else x for x in xs]) for i, (base, source, xs) in _AGAIN.items()}
_STEPS = ", ".join(f"('{x}')" for x in ("main", "event", "robustness", "permutation", "reproduction"))


# the coefficients of the main model and of its checks; the other steps only say that they succeeded
@query(f"WITH {NATION_YEAR}, " + ", ".join(f"{unrolled(source, 40, ('y', *xs), f'{i}z')}, {several(f'{i}z40', xs, f'{_TWO_K} + {len(xs) - 1}', name=i)}" for i, (_, source, xs) in _RUN.items()) + f" SELECT step, 'succeeded' AS status, CAST(NULL AS DOUBLE) AS coef FROM (VALUES {_STEPS}) s(step) WHERE step NOT IN ('main', 'robustness') UNION ALL " + " UNION ALL ".join(f"SELECT '{'main' if i == 'main' else 'robustness'}' AS step, 'succeeded' AS status, round(b0, 7) AS coef FROM {i}" for i in _RUN))
def engine_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of one run of a specification, with the coefficients of its main model and checks."""
    spec = replace(_spec(treatment="a", permutation_n=19), robustness=(Check("r1", "exclude_years", {"years": [2001]}), Check("r2", "add_controls", {"controls": ["log1p(n)"]})))
    out = engine.run(spec, panels.nation_year(spark, sf_dir))
    rows = [("main", out["steps"]["main"]["status"], round(out["main"]["coef"], 7))]
    rows += [("robustness", c["status"], c.get("coef") and round(c["coef"], 7)) for c in out["robustness"]]
    rows += [(k, v["status"], None) for k, v in out["steps"].items() if k not in ("main", "robustness")]
    return spark.createDataFrame(rows, "step string, status string, coef double")
