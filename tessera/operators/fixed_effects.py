"""Least squares with unit and time effects and clustered inference, in closed form.

Units are absorbed by demeaning; what time effects remain is one small linear system: with n_ut
the cell counts, its matrix is diag(n_t) - sum_u n_ut n_us / n_u and its right side the sums of
unit-demeaned values by period. Spark makes these sums, the Gram matrix and the cluster scores;
the driver solves systems of the number of periods and of regressors, and an
unbalanced panel needs nothing special. A panel of more than MOST_PERIODS periods and a unit
effect exchanges the roles if it has fewer units; if both are many, the system is solved by
conjugate gradients on tables of levels, without being made.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions.distributions import t_ppf, t_sf
from tessera.operators.tables import written

MOST_PERIODS = 2000
#: Means of an effect that may be sent to every task: some MB.
MOST_LEVELS = 50_000
ROUNDS = 500
#: Of the residual, by the norm of the preconditioner, relative to the first.
GRADIENT_TOLERANCE = 1e-13


@dataclass
class Fit:
    names: list[str]
    params: np.ndarray
    cov: np.ndarray
    n_obs: int
    n_units: int
    n_clusters: int
    df_model: int
    df_resid: int
    r2_within: float

    def summary(self, name: str) -> dict:
        """Estimate and inference with n_clusters - 1 degrees of freedom."""
        if name not in self.names:
            raise EngineError("target_absorbed", f"{name} is absorbed by the fixed effects")
        i, df = self.names.index(name), self.n_clusters - 1
        coef, variance = float(self.params[i]), float(self.cov[i, i])
        se = math.sqrt(variance) if variance > 0 else 0.0
        if df < 1 or se <= 0 or not math.isfinite(coef) or not math.isfinite(se):
            raise EngineError("invalid_inference", "the estimate or its standard error is not finite and positive")
        t, reach = coef / se, t_ppf(0.975, df) * se
        return {"target": name, "coef": coef, "se": se, "t": t, "p": 2 * t_sf(abs(t), df), "ci_low": coef - reach, "ci_high": coef + reach, "inference_df": df, "n_clusters": self.n_clusters, "n_obs": self.n_obs, "n_units": self.n_units, "df_model": self.df_model, "df_resid": self.df_resid, "r2_within": self.r2_within}


def facts_of(df: DataFrame, columns: list[str], effects: tuple[str, ...] = ("unit", "time")) -> Row:
    """One pass: n, levels of the effects and of cluster if there is one, mean and total sum of
    squares (ss_...) of the columns."""
    kinds = [*effects, *(["cluster"] if "cluster" in df.columns else [])]
    return df.agg(F.count("*").alias("n"), *[F.count_distinct(k).alias(k) for k in kinds], *[F.avg(c).alias(f"mean_{c}") for c in columns], *[(F.var_pop(c) * F.count(c)).alias(f"ss_{c}") for c in columns]).first()


def without_means(df: DataFrame, columns: list[str], effect: str, levels: int) -> DataFrame:
    """The columns freed of the means of one effect. Units have a window each; periods are few and
    hold very many rows, so their means are aggregates that are joined, broadcast up to
    MOST_LEVELS of them."""
    if effect == "unit":
        w = Window.partitionBy("unit")
        return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})
    means = df.groupBy(F.col(effect).alias("_level")).agg(*[F.avg(c).alias(f"_mean_{i}") for i, c in enumerate(columns)])
    joined = df.join(F.broadcast(means) if levels <= MOST_LEVELS else means, F.col(effect).eqNullSafe(F.col("_level")))
    return joined.withColumns({c: F.col(c) - F.col(f"_mean_{i}") for i, c in enumerate(columns)}).drop("_level", *[f"_mean_{i}" for i in range(len(columns))])


def shared_cells(df: DataFrame, big: str, small: str) -> list[Row]:
    """(s, r, v): for levels s and r of ``small`` the sum of n_s n_r / n over levels of ``big``.
    Levels with the same cell counts are counted once, so a complete panel has one pattern."""
    cells = df.groupBy(F.col(big).alias("b"), F.col(small).alias("s")).agg(F.count("*").alias("n"))
    patterns = cells.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("p")).groupBy("p").agg(F.count("*").alias("k"))
    whole = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    pairs = patterns.select("p", (F.col("k") / whole).alias("w"), F.explode("p").alias("x")).select("w", "x", F.explode("p").alias("y"))
    return pairs.groupBy(F.col("x.s").alias("s"), F.col("y.s").alias("r")).agg(F.sum(F.col("w") * F.col("x.n") * F.col("y.n")).alias("v")).collect()


def demeaned(df: DataFrame, columns: list[str], effects: list[str], facts: Row | None = None) -> DataFrame:
    """``df`` (unit, time, ...) with the columns freed of the effects, ``unit`` and ``time``."""
    effects = [e for e in ("unit", "time") if e in effects]
    facts = facts or facts_of(df, columns)
    df = df.withColumns({c: F.col(c) - F.lit(float(facts[f"mean_{c}"] or 0.0)) for c in columns})
    if len(effects) < 2:
        return without_means(df, columns, effects[0], facts[effects[0]]) if effects else df
    big, small = "unit", "time"
    if facts[small] > facts[big]:
        big, small = small, big
    if facts[small] > MOST_PERIODS:
        return _by_gradients(df, columns, facts, big, small)
    free = without_means(df, columns, big, facts[big])
    right = {r["s"]: r for r in free.groupBy(F.col(small).alias("s")).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"v{i}") for i, c in enumerate(columns)]).collect()}
    order = sorted(right)
    at = {s: i for i, s in enumerate(order)}
    system = np.diag([float(right[s]["n"]) for s in order])
    for r in shared_cells(df, big, small):
        system[at[r["s"]], at[r["r"]]] -= r["v"]
    sums = np.array([[right[s][f"v{i}"] for i in range(len(columns))] for s in order], float)
    effect = np.linalg.lstsq(system, sums, rcond=1e-12)[0]
    names = [f"_g{i}" for i in range(len(columns))]
    table = df.sparkSession.createDataFrame([(s, *map(float, effect[at[s]])) for s in order], [small, *names])
    joined = df.join(F.broadcast(table), small)  # at most MOST_PERIODS rows
    joined = joined.withColumns({c: F.col(c) - F.col(g) for c, g in zip(columns, names, strict=True)}).drop(*names)
    return without_means(joined, columns, big, facts[big])


def _times_system(cells: DataFrame, vector: DataFrame, names: list[str], levels: dict[str, int]) -> DataFrame:
    """s and a_<name>, the system of levels of the smaller effect times the columns of ``vector`` (s,
    n, names). cells: b, s, n and share, the cell's part of its level b. Vectors of up to
    MOST_LEVELS levels are broadcast."""
    near = lambda df, effect: F.broadcast(df) if levels[effect] <= MOST_LEVELS else df
    means = cells.join(near(vector.select("s", *names), "s"), "s").groupBy("b").agg(*[F.sum(F.col("share") * F.col(c)).alias(f"m_{c}") for c in names])
    taken = cells.join(near(means, "b"), "b").groupBy("s").agg(*[F.sum(F.col("n") * F.col(f"m_{c}")).alias(f"t_{c}") for c in names])
    return vector.join(taken, "s").select(*vector.columns, *[(F.col("total") * F.col(c) - F.col(f"t_{c}")).alias(f"a_{c}") for c in names])


def _by_gradients(df: DataFrame, columns: list[str], facts: Row, big: str, small: str) -> DataFrame:
    """The columns freed of two effects with many levels each: the system of the smaller one's
    levels is solved by conjugate gradients, preconditioned by its diagonal, for all columns at once.

    The system is never made. A round multiplies it with a vector, which takes the cells of the two
    effects and two vectors of levels, and writes one row for each level; the driver has a few
    sums for each column. A panel that falls apart into unconnected sets needs nothing special."""
    levels = {"b": facts[big], "s": facts[small]}
    counted = df.groupBy(F.col(big).alias("b"), F.col(small).alias("s")).agg(F.count("*").cast("double").alias("n"))
    whole = counted.groupBy("b").agg(F.sum("n").alias("of_b"))
    cells = written(counted.join(whole, "b").select("b", "s", "n", (F.col("n") / F.col("of_b")).alias("share")), "cells")
    free = without_means(df, columns, big, facts[big])
    right = free.groupBy(F.col(small).alias("s")).agg(*[F.sum(c).alias(f"r{i}") for i, c in enumerate(columns)])
    scale = cells.groupBy("s").agg(F.sum("n").alias("total"), (F.sum("n") - F.sum(F.col("n") * F.col("share"))).alias("_own"))
    # a level whose cells are alone in theirs is free of all others
    scale = scale.select("s", "total", F.when(F.col("_own") > 1e-9 * F.col("total"), F.col("_own")).otherwise(F.col("total")).alias("own"))
    k = range(len(columns))
    state = right.join(scale, "s").withColumns({f"x{i}": F.lit(0.0) for i in k}).withColumns({f"p{i}": F.col(f"r{i}") / F.col("own") for i in k})
    first: list[float] = []
    for _ in range(ROUNDS):
        state = written(_times_system(cells, state, [f"p{i}" for i in k], levels), "gradients")
        dot = lambda a, b, i: F.coalesce(F.sum(F.col(f"{a}{i}") * F.col(f"{b}{i}") / (F.lit(1.0) if a == "p" else F.col("own"))), F.lit(0.0)).alias(f"{a}{b}{i}")
        sums = state.agg(*[dot(a, b, i) for i in k for a, b in (("p", "a_p"), ("r", "r"), ("r", "a_p"), ("a_p", "a_p"))]).first()
        left = [sums[f"rr{i}"] for i in k]
        first = first or left
        live = [left[i] > GRADIENT_TOLERANCE**2 * first[i] and sums[f"pa_p{i}"] > 0 for i in k]
        if not any(live):
            break
        step = [left[i] / sums[f"pa_p{i}"] if live[i] else 0.0 for i in k]
        after = [left[i] - 2 * step[i] * sums[f"ra_p{i}"] + step[i] ** 2 * sums[f"a_pa_p{i}"] for i in k]
        keep = [max(after[i], 0.0) / left[i] if live[i] else 0.0 for i in k]
        residual = [F.col(f"r{i}") - F.lit(step[i]) * F.col(f"a_p{i}") for i in k]
        state = state.select("s", "total", "own", *[residual[i].alias(f"r{i}") for i in k], *[(F.col(f"x{i}") + F.lit(step[i]) * F.col(f"p{i}")).alias(f"x{i}") for i in k], *[(residual[i] / F.col("own") + F.lit(keep[i]) * F.col(f"p{i}")).alias(f"p{i}") for i in k])
    else:
        raise EngineError("demean_failed", f"effects did not settle in {ROUNDS} rounds")
    effect = state.select(F.col("s").alias("_level"), *[F.col(f"x{i}").alias(f"_g{i}") for i in k])
    joined = df.join(F.broadcast(effect) if levels["s"] <= MOST_LEVELS else effect, F.col(small) == F.col("_level"))
    joined = joined.withColumns({c: F.col(c) - F.col(f"_g{i}") for i, c in enumerate(columns)}).drop("_level", *[f"_g{i}" for i in k])
    return without_means(joined, columns, big, facts[big])


def fit(clean: DataFrame, regressors: list[str], effects: list[str], drop_absorbed: bool = False) -> Fit:
    """Regression of y on the regressors of ``clean`` (unit, time, cluster, y, regressors)."""
    effects = [e for e in ("unit", "time") if e in effects]
    names = ["y", *regressors]
    facts = facts_of(clean, names)
    free = demeaned(clean.select("unit", "time", "cluster", *names), names, effects, facts)
    upper = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = free.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in upper]).first()
    gram = np.zeros((len(names), len(names)))
    for i, j in upper:
        gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"] or 0.0
    keep = independent(gram[1:, 1:], np.array([float(facts[f"ss_{c}"] or 0) for c in regressors]))
    if len(keep) < len(regressors) and not drop_absorbed:
        raise EngineError("estimation_failed", "regressors are collinear or absorbed by the fixed effects")
    if not keep:
        raise EngineError("estimation_failed", "no regressor is left")
    used = [regressors[i] for i in keep]
    rows = [1 + i for i in keep]
    bread = np.linalg.inv(gram[np.ix_(rows, rows)])
    params = bread @ gram[rows, 0]
    k = 1 + len(used) + sum(int(facts[e]) - 1 for e in effects)
    n, g = int(facts["n"]), int(facts["cluster"])
    if n <= k or g < 2:
        raise EngineError("estimation_failed", "too few observations or clusters")
    resid = F.col("y")
    for b, c in zip(params, used, strict=True):
        resid = resid - F.lit(float(b)) * F.col(c)
    scores = free.withColumn("_e", resid).groupBy("cluster").agg(*[F.sum(F.col(c) * F.col("_e")).alias(f"s{i}") for i, c in enumerate(used)])
    pairs = [(i, j) for i in range(len(used)) for j in range(i, len(used))]
    sums = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    meat = np.zeros((len(used), len(used)))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = sums[f"m{i}_{j}"] or 0.0
    cov = bread @ meat @ bread * (g / (g - 1)) * ((n - 1) / (n - k))
    explained = float(params @ gram[rows, 0])
    return Fit(used, params, cov, n, int(facts["unit"]), g, k, n - k, explained / gram[0, 0] if gram[0, 0] > 0 else 0.0)


def independent(gram: np.ndarray, scale: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Indexes of columns that add something to those before them, by elimination in order.
    ``scale``: each column's sum of squares before effects were taken out."""
    left, keep = gram.copy(), []
    for i in range(len(gram)):
        if left[i, i] > tolerance * max(scale[i], 1e-300) and left[i, i] > 0:
            keep.append(i)
            left = left - np.outer(left[:, i], left[i]) / left[i, i]
    return keep
