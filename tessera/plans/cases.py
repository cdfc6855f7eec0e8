"""The shipped example case, and whether a plan is ready to run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions.formula import resolve
from tessera.operators import panel
from tessera.plans.spec import Check

# Columns of the example's source and their names here.
COLUMNS = {
    "Symbol": "firm_id",
    "year": "year",
    "IndustryCode": "industry_code",
    "PROVINCECODE": "province_code",
    "CITYCODE": "city_code",
    "carbon_post": "industry_peer_exposure",
    "green_patent1": "green_all_independent",
    "green_patent2": "green_invention_independent",
    "green_patent3": "green_utility_independent",
    "green_patent4": "green_all_joint",
    "green_patent5": "green_invention_joint",
    "green_patent6": "green_utility_joint",
    "Size": "total_assets",
    "Lev": "leverage",
    "ROA": "return_on_assets",
    "SOE": "state_ownership",
    "HHI_A": "industry_concentration",
    "FC_index": "fc_index",
    "KZ_index": "kz_index",
    "SA_index": "sa_index",
    "WW_index": "ww_index",
}
# The example's roles, binding and checks.
CASE_ROLES = {"outcome": ["patents"], "treatment": ["exposure"], "unit": ["firm"], "time": ["year"], "control": ["log_assets", "leverage", "profitability"]}
CASE_BINDING = {"patents": "log1p(green_invention_independent + green_invention_joint)", "exposure": "industry_peer_exposure", "firm": "firm_id", "year": "year", "log_assets": "log(total_assets)", "leverage": "leverage", "profitability": "return_on_assets"}
CASE_CHECKS = (
    Check("exclude_years", "exclude_years", {"years": [2020, 2021]}, "剔除疫情年份"),
    Check("drop_controls", "drop_controls", {}, "去除基准控制变量"),
    Check("alt_outcome", "alt_outcome", {"outcome": "log1p(green_all_independent + green_all_joint)"}, "改用全部绿色专利"),
    Check("monotone_only", "monotone_only", {}, "仅保留暴露不回退企业"),
)


def materialise(df: DataFrame, names: list[str], binding: dict[str, str], as_they_are: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Columns for the names that can be bound, and the names that can't."""
    cols, absent = [], []
    for name in names:
        try:
            text = binding[name]
            cols.append((df[text] if name in as_they_are and text in df.columns else resolve(df, text)).alias(name))
        except (KeyError, EngineError):
            absent.append(name)
    return df.select(*cols), absent


def readiness(df: DataFrame, roles: dict[str, list[str]], binding: dict[str, str] | None, plan_confirmed: bool, binding_confirmed: bool, method_family: str = "policy_causal", plan_stale: bool = False, plan_fits: bool = True) -> dict:
    """status (ready or not_ready), missing names, bound names, todo (the data plan: what is to be done
    until the data are ready, in order), and the sample report.

    Without a binding nothing is looked at but the plan. ``plan_fits``: the plan satisfies the
    checks of its case."""
    todo = [] if plan_fits else ["revise the plan to fit its case"]
    todo += [] if plan_confirmed and not plan_stale else ["confirm the plan"]
    names = [n for ns in roles.values() for n in ns]
    if binding is None:
        return {"status": "not_ready", "missing": names, "bound": [], "todo": [*todo, "choose data and bind: " + ", ".join(names)], "sample": None}
    todo += [] if binding_confirmed else ["confirm the binding"]
    ready, missing = materialise(df, names, binding, roles.get("unit", []))
    todo += [f"bind {n}" for n in missing]
    sample = None
    if not missing:
        one = lambda r: roles[r][0]
        others = [n for r, ns in roles.items() if r not in ("unit", "time", "treatment", "outcome") for n in ns]
        try:
            sample = panel.sample_report(ready, one("unit"), one("time"), one("treatment"), one("outcome"), others).first().asDict()
            todo += _problems(ready, sample, one("treatment"), one("outcome"), method_family)
        except EngineError as e:
            todo.append(e.message)
    return {"status": "not_ready" if todo else "ready", "missing": missing, "bound": sorted(binding), "todo": todo, "sample": sample}


def _problems(ready: DataFrame, sample: dict, treatment: str, outcome: str, method_family: str) -> list[str]:
    problems = {"fewer than 10 valid rows": sample["n_valid"] < 10, "keys repeat": sample["duplicates"] > 0, "fewer than two units or periods": sample["n_units"] < 2 or sample["n_periods"] < 2}
    if method_family == "policy_causal":
        problems |= {"the treatment is not 0 or 1": not sample["binary_treatment"], "exposed and never exposed units are needed": bool(sample["binary_treatment"]) and not (sample["treated_units"] and sample["control_units"])}
    varies = lambda c, name: F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(name)
    spread = ready.dropna().agg(varies(treatment, "treatment"), varies(outcome, "outcome")).first()
    problems |= {"the treatment does not vary": not spread["treatment"], "the outcome does not vary": not spread["outcome"]}
    return [p for p, is_so in problems.items() if is_so]
