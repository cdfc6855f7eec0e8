"""Known truth, analytic equalities, error paths."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from tessera.errors import EngineError
from tessera.functions.distributions import f_sf, t_ppf, t_sf
from tessera.operators import analysis, fixed_effects, panel
from tessera.plans import engine
from tessera.plans.spec import Check, Spec, compile_check, compile_spec, field_semantics


def known_truth(units=60, tau=0.3, seed=2026):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(units):
        start = 99 if u % 4 == 3 else 4 + 2 * (u % 3)
        level = rng.normal()
        for t in range(12):
            x, z, d = rng.normal(), rng.normal(), float(t >= start)
            y = level + 0.03 * t + 0.2 * x + tau * d + rng.normal(0, 0.12)
            rows.append((u, 2010 + t, y, d, x, z, y + rng.normal(0, 0.05)))
    return pd.DataFrame(rows, columns=["firm", "year", "y", "d", "x", "z", "y_alt"])


SPEC = Spec(unit="firm", time="year", outcome="y", treatment="d", controls=("x",), bins=(-4, -3, -2, 0, 1, 2, 3, 4), permutation_n=99)
CHECKS = (
    Check("1", "drop_controls", {"controls": ["x"]}),
    Check("2", "exclude_years", {"years": [2021]}),
    Check("3", "monotone_only"),
    Check("4", "alt_outcome", {"outcome": "y_alt"}),
    Check("5", "add_controls", {"controls": ["z"]}),
    Check("6", "exclude_years", {"years": [1900]}),
)


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame(known_truth()).persist()


def test_effect_is_recovered_and_recomputed(truth):
    out = engine.run(replace(SPEC, robustness=CHECKS), truth)
    assert abs(out["main"]["coef"] - 0.3) < 2 * out["main"]["se"]
    assert [c["status"] for c in out["robustness"]] == ["succeeded"] * 5 + ["failed"]
    assert out["permutation"]["p"] < 0.05 and out["permutation"]["n"] == 99
    assert -1 not in [t["k"] for t in out["event"]["terms"]] and out["event"]["pretrend_wald"]["p"] > 0.01
    rep = out["reproduction"]
    assert rep["consistent"] and rep["max_relative_diff"] < 1e-6
    assert [(r["status"], r["origin"]) for r in rep["rows"]][-1] == ("failed", "analysis")
    assert all(s["status"] == "succeeded" for s in out["steps"].values())


def test_no_effect_is_not_found(spark):
    raw = spark.createDataFrame(known_truth(tau=0.0, seed=5))
    summary = analysis.permutation_summary(*analysis.permutation_draws(SPEC, raw)).first()
    assert summary["p"] >= 0.05


@pytest.mark.parametrize("effects", [(), ("unit",), ("time",), ("unit", "time")])
def test_closed_form_equals_dummy_regression(spark, effects):
    data = known_truth(20)
    data = data[data.index % 37 != 0].reset_index(drop=True)  # unbalanced
    raw = spark.createDataFrame(data)
    spec = replace(SPEC, fe=effects)
    got = analysis.estimate(spec, raw)
    x = [data[["d", "x"]].to_numpy(float), np.ones((len(data), 1))]
    for e, c in (("unit", "firm"), ("time", "year")):
        if e in effects:
            x.append(pd.get_dummies(data[c]).to_numpy(float)[:, 1:])
    x = np.hstack(x)
    b = np.linalg.lstsq(x, data["y"].to_numpy(), rcond=None)[0]
    e = data["y"].to_numpy() - x @ b
    scores = np.stack([(x[data.firm == u] * e[data.firm == u, None]).sum(0) for u in data.firm.unique()])
    bread = np.linalg.inv(x.T @ x)
    n, k, g = len(data), x.shape[1], len(scores)
    se = np.sqrt((bread @ scores.T @ scores @ bread)[0, 0] * g / (g - 1) * (n - 1) / (n - k))
    assert got["coef"] == pytest.approx(b[0], abs=1e-9) and got["se"] == pytest.approx(se, abs=1e-9)
    assert got["inference_df"] == g - 1


def test_gradients_equal_the_closed_form(spark, monkeypatch):
    data = known_truth(15)
    d = spark.createDataFrame(data[data.index % 11 != 0]).selectExpr("firm unit", "year time", "firm cluster", "y", "d")
    one = fixed_effects.fit(d, ["d"], ["unit", "time"]).summary("d")
    monkeypatch.setattr(fixed_effects, "MOST_PERIODS", 3)
    monkeypatch.setattr(fixed_effects, "ROUNDS", 60)
    two = fixed_effects.fit(d, ["d"], ["unit", "time"]).summary("d")
    assert one["coef"] == pytest.approx(two["coef"], abs=1e-8) and one["se"] == pytest.approx(two["se"], abs=1e-8)


def test_interaction_permutation_equals_regression(spark):
    data = known_truth(24)
    rng = np.random.default_rng(3)
    data["m"] = rng.normal(size=len(data))
    data["y"] += 0.6 * data.d * data.m
    raw = spark.createDataFrame(data)
    spec = replace(SPEC, controls=(), method_family="mechanism_boundary", moderator="m")
    observed = analysis.permutation_draws(spec, raw)[0]
    assert observed == pytest.approx(analysis.estimate(spec, raw)["coef"], abs=1e-9)


def test_mechanism_takes_the_outcomes_place(truth):
    spec = replace(SPEC, method_family="mechanism_boundary", mechanism="y_alt", outcome="z")
    assert analysis.estimate(spec, truth)["coef"] == pytest.approx(analysis.estimate(replace(SPEC, outcome="y_alt"), truth)["coef"])


def test_error_paths(spark, truth):
    for spec, code in ((replace(SPEC, unit="nope"), "missing_field"), (replace(SPEC, cluster="nope"), "missing_cluster"), (replace(SPEC, treatment="x"), "invalid_treatment"), (replace(SPEC, treatment="firm * 1", method_family="panel_association"), "estimation_failed"), (replace(SPEC, filters=(("year", "eq", 1),)), "empty_sample"), (replace(SPEC, method_family="mechanism_boundary"), "mechanism_missing")):
        with pytest.raises(EngineError) as e:
            analysis.estimate(spec, truth)
        assert e.value.code == code
    with pytest.raises(EngineError, match="duplicate_panel"):
        analysis.estimate(SPEC, truth.unionByName(truth.limit(1)))


def test_monotony_is_judged_on_unfiltered_rows(spark):
    data = known_truth(16)
    data.loc[(data.firm == 0) & (data.year == 2021), "d"] = 0.0  # falls in a year that is filtered out
    out = analysis.event_study(replace(SPEC, filters=(("year", "le", 2020),)), spark.createDataFrame(data))
    assert out["excluded_nonmonotone_units"] == 1


def test_distributions():
    assert t_ppf(0.975, 10) == pytest.approx(2.2281388520, abs=1e-9)
    assert f_sf(2.0, 3, 30) == pytest.approx(0.1351, abs=1e-3)
    assert t_sf(0, 5) == 0.5 and t_sf(t_ppf(0.9, 7), 7) == pytest.approx(0.1) and t_ppf(0.1, 7) == -t_ppf(0.9, 7)
    assert f_sf(2.0, 1, 10) == pytest.approx(2 * t_sf(2**0.5, 10))


def test_readiness(spark):
    rows = [(u, 2010 + t, float(u * t), int(u < 3 and t >= 3), 10.0 + u) for u in range(6) for t in range(8)]
    d = spark.createDataFrame(rows, "firm_id long, year long, y double, d int, assets double")
    r = panel.sample_report(d, "firm_id", "year", "d", "y", ["assets"]).first()
    assert (r.n_valid, r.treated_units, r.control_units, r.monotone_units, r.reversal_transitions, r.duplicates) == (48, 3, 3, 6, 0, 0)
    assert [tuple(x) for x in panel.cohort_sizes(panel.trajectories(d, "firm_id", "year", "d")).collect()] == [(2013.0, 3)]
    i = panel.panel_info(d).first()
    assert i.unit == "firm_id" and i.balanced and i.time_min == "2010"


def test_profile_and_filters(spark):
    d = spark.createDataFrame([(1, 1.0, "a"), (1, None, "b"), (2, float("nan"), None), (2, float("inf"), "a")], "id int, v double, s string")
    p = {r.name: r for r in panel.profile(d).collect()}
    assert p["v"].missing_rate == 0.5 and p["v"].max == 1.0 and p["s"].unique_count == 2 and p["s"].min is None
    assert panel.apply_filters(d, [("v", "ne", 1.0)]).count() == 3 and panel.apply_filters(d, [("v", "ge", 1.0)]).count() == 2
    info = panel.panel_info(spark.createDataFrame([(1, 1), (1, 1), (None, 2)], "unit int, time int")).first()
    assert (info.duplicates, info.missing_keys, info.balanced) == (1, 1, False)


def test_compilation():
    roles = {"unit": ["u"], "time": ["t"], "outcome": ["o"], "treatment": ["d"], "control": ["size"]}
    binding = {"u": "firm", "t": "year", "o": "log(sales)", "d": "treated", "size": "log(assets)", "age": "age_years"}
    spec = compile_spec(roles, binding, [Check("a", "add_controls", {"controls": ["age"]}), Check("b", "drop_controls", {"controls": ["size"]}), Check("c", "drop_controls")])
    assert [c.args for c in spec.robustness] == [{"controls": ["age_years"]}, {"controls": ["log(assets)"]}, {"controls": ["log(assets)"]}]
    for bad in (Check("a", "add_controls", {"controls": ["size"]}), Check("b", "drop_controls", {"controls": ["age"]}), Check("c", "exclude_years", {"years": ["x"]}), Check("d", "alt_outcome", {"outcome": "__import__('os')"}), Check("e", "other")):
        with pytest.raises(EngineError):
            compile_check(bad, ["log(assets)"], binding)
    with pytest.raises(EngineError):
        Spec(unit="u", time="t", outcome="y", treatment="d", bins=(-3, -2, 0, 2))
    assert field_semantics("d * 1", {"d": "peer_exposure"}) == "peer_exposure" and field_semantics("a + b", {"a": "real_assignment"}) == "unknown"


def test_schemas_of_all_tables(spark):
    from tessera.plans import statistics_queries

    out = statistics_queries.file_schema_inspect(spark, "/root/testdata/sf0.001").select("table").distinct()
    assert out.count() == 14
