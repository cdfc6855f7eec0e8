"""Permutation against a plain computation of every draw, and places in long groups."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.operators import analysis, fixed_effects, permutation
from tessera.operators.ranks import ranked
from tessera.plans.spec import Spec

SPEC = Spec(unit="firm", time="year", outcome="y", treatment="d", method_family="panel_association", permutation_n=70)


def panel(units=23, periods=6, seed=1, gaps=0.0, binary=False):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(units):
        start = rng.integers(1, periods + 3)
        for t in range(periods):
            d = float(t >= start) if binary else rng.normal() + 50
            rows.append((f"f{u:03d}", 2000 + t, rng.normal() + 0.3 * d + u, d, rng.normal() + 7))
    data = pd.DataFrame(rows, columns=["firm", "year", "y", "d", "m"])
    data.loc[rng.random(len(data)) < gaps, "y"] = np.nan
    return data


def plain(data, n, seed, effects, moderated):
    """Coefficients of the observed order and of n draws, by least squares with indicators."""
    grid = data.pivot(index="firm", columns="year", values="d").dropna()
    rows = data[data.y.notna() & data.firm.isin(grid.index)]
    grid = grid.loc[grid.index.isin(rows.firm)]
    unit, time = grid.index.get_indexer(rows.firm), grid.columns.get_indexer(rows.year)
    dummies = [np.ones((len(rows), 1))]
    dummies += [np.eye(len(grid))[unit]] if "unit" in effects else []
    dummies += [np.eye(grid.shape[1])[time]] if "time" in effects else []
    rng = np.random.default_rng(seed)
    out = []
    for order in [np.arange(len(grid)), *[rng.permutation(len(grid)) for _ in range(n)]]:
        d = grid.to_numpy()[order[unit], time]
        x = [d[:, None], *dummies]
        if moderated:
            x = [(d * rows.m.to_numpy())[:, None], rows.m.to_numpy()[:, None], *x]
        x = np.hstack(x)
        # what the other columns leave of the first
        rest = x[:, 0] - x[:, 1:] @ np.linalg.lstsq(x[:, 1:], x[:, 0], rcond=None)[0]
        out.append(rest @ rows.y.to_numpy() / (rest @ rest) if rest @ rest > 1e-9 else np.nan)
    return out


@pytest.mark.parametrize("gaps, binary, effects, moderated", [(0.0, True, ("unit", "time"), False), (0.2, False, ("unit", "time"), False), (0.2, True, ("unit",), False), (0.15, False, ("time",), False), (0.1, False, (), False), (0.2, False, ("unit", "time"), True), (0.0, True, ("unit",), True)])
def test_draws_equal_least_squares(spark, monkeypatch, gaps, binary, effects, moderated):
    monkeypatch.setattr(permutation, "BLOCK", 30)  # five units a block
    monkeypatch.setattr(permutation, "PORTION", 100)
    data = panel(gaps=gaps, binary=binary)
    data.loc[3, "d"] = np.nan  # no complete path
    spec = replace(SPEC, fe=effects, **({"method_family": "mechanism_boundary", "moderator": "m"} if moderated else {}))
    observed, draws = analysis.permutation_draws(spec, spark.createDataFrame(data))
    rows = {r.draw: r.coef for r in draws.collect()}
    want = plain(data, spec.permutation_n, spec.permutation_seed, effects, moderated)
    assert observed == pytest.approx(want[0], abs=1e-8)
    assert [rows[k] for k in range(spec.permutation_n)] == pytest.approx(want[1:], abs=1e-8, nan_ok=True)


def test_a_constant_treatment_and_too_few_units(spark):
    data = panel(6)
    with pytest.raises(EngineError, match="permutation_constant"):
        analysis.permutation_draws(SPEC, spark.createDataFrame(data.assign(d=1.0)))
    few = spark.createDataFrame(panel(2, 8))
    with pytest.raises(EngineError, match="permutation_empty"):
        analysis.permutation_draws(SPEC, few)


def test_many_levels_of_both_effects(spark, monkeypatch):
    """5,000 units by 5,000 periods, against the dense system of periods."""
    rng = np.random.default_rng(4)
    size = 5_000
    unit, time = (np.r_[np.arange(size), rng.integers(0, size, 40_000)] for _ in range(2))
    _, once = np.unique(unit * size + time, return_index=True)
    unit, time = unit[once], time[once]
    x = rng.normal(size=len(unit)) + 0.1 * unit / size
    y = 0.5 * x + rng.normal(size=size)[unit] + rng.normal(size=size)[time] + rng.normal(size=len(unit))
    rounds = []
    kept = fixed_effects.written
    monkeypatch.setattr(fixed_effects, "written", lambda df, name: rounds.append(name) or kept(df, name))
    df = spark.createDataFrame(pd.DataFrame({"unit": unit, "time": time, "cluster": unit, "y": y, "x": x}))
    got = fixed_effects.fit(df, ["x"], ["unit", "time"])
    assert rounds.count("gradients") < 40
    n_u, n_t = np.bincount(unit, minlength=size), np.bincount(time, minlength=size)
    cells = np.zeros((size, size))
    np.add.at(cells, (unit, time), 1.0)
    system = np.diag(n_t.astype(float)) - cells.T @ (cells / n_u[:, None])

    def freed(v):
        lean = v - (np.bincount(unit, v, size) / n_u)[unit]
        right = np.bincount(time, lean, size)
        effect = np.r_[0.0, np.linalg.solve(system[1:, 1:], right[1:])]  # one period is the base
        v = v - effect[time]
        return v - (np.bincount(unit, v, size) / n_u)[unit]

    fx, fy = freed(x), freed(y)
    assert got.params[0] == pytest.approx(fx @ fy / (fx @ fx), abs=1e-10)
    e = fy - fx * got.params[0]
    k, g = 1 + 1 + 2 * (size - 1), size
    meat = (np.bincount(unit, fx * e, size) ** 2).sum()
    assert got.cov[0, 0] == pytest.approx(meat / (fx @ fx) ** 2 * g / (g - 1) * (len(x) - 1) / (len(x) - k), rel=1e-8)


def test_unconnected_sets_by_gradients(spark, monkeypatch):
    data = panel(12, 8, gaps=0.0)
    data = data[(data.firm < "f006") == (data.year < 2004)]
    d = spark.createDataFrame(data).selectExpr("firm unit", "year time", "firm cluster", "y", "d", "m")
    one = fixed_effects.fit(d, ["d", "m"], ["unit", "time"]).summary("d")
    monkeypatch.setattr(fixed_effects, "MOST_PERIODS", 3)
    two = fixed_effects.fit(d, ["d", "m"], ["unit", "time"]).summary("d")
    assert one["coef"] == pytest.approx(two["coef"], abs=1e-9) and one["se"] == pytest.approx(two["se"], abs=1e-9)


def test_places_in_long_groups(spark):
    rows = [(g, i, (i * 7919) % 1000) for g, n in (("a", 900), (None, 50), ("b", 3)) for i in range(n)]
    d = spark.createDataFrame(rows, "g string, i int, v int")
    got = ranked(d, ["g"], [F.desc("v"), F.asc("i")], "place")
    assert got.columns == ["g", "i", "v", "place"]
    want = {}
    for g in ("a", None, "b"):
        for place, (_, i) in enumerate(sorted((-v, i) for x, i, v in rows if x == g), 1):
            want[g, i] = place
    assert {(r.g, r.i): r.place for r in got.collect()} == want
    spread = got.where("g = 'a'").select("place").distinct().count()
    assert spread == 900
    assert ranked(d.where("false"), [], [F.col("i")], "place").count() == 0


def test_entries_of_an_order_are_made_block_by_block():
    import pyarrow as pa

    order = np.random.default_rng(5).permutation(1000)
    got = list(permutation._entries(100, lambda batch: iter([(7, 450, order)]))([pa.RecordBatch.from_pydict({"x": [1]})]))
    assert len(got) == 10 and all(sum(map(len, b.column(5).to_pylist())) <= 100 * 8 for b in got)
    found = {}
    for b in got:
        for r in b.to_pylist():
            assert r["s"] == 0 and r["draw"] == 450  # ten blocks: chunks of ten times as many draws
            for u, v in np.frombuffer(r["data"], np.int32).reshape(-1, 2):
                found[r["i"] * 100 + u] = r["j"] * 100 + v
    assert [found[k] for k in range(1000)] == order.tolist()
