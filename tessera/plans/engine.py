"""One run of a specification: main model, event study, robustness, permutation, recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.errors import EngineError
from tessera.operators import analysis
from tessera.plans.spec import Spec


def run(spec: Spec, raw: DataFrame, permute: bool = True, recompute: bool = True) -> dict:
    """Results and the status of each step. The main model must succeed; what fails after it is
    recorded and the rest goes on. The input is cached for the steps."""
    raw = raw.persist()
    steps: dict[str, dict] = {}

    def step(name: str, make):
        try:
            out = make()
            steps[name] = {"status": "succeeded"}
            return out
        except EngineError as e:
            steps[name] = {"status": "failed", "error": e.message}
            return None

    try:
        result: dict = {"main": analysis.estimate(spec, raw)}
        steps["main"] = {"status": "succeeded"}
        if spec.method_family == "policy_causal":
            result["event"] = step("event", lambda: analysis.event_study(spec, raw))
        result["robustness"] = step("robustness", lambda: analysis.robustness(spec, raw))
        if permute:
            result["permutation"] = step("permutation", lambda: analysis.permutation_summary(*analysis.permutation_draws(spec, raw)).first().asDict())
        if recompute:
            result["reproduction"] = step("reproduction", lambda: analysis.reproduce(spec, raw, result["main"], result["robustness"] or []))
    finally:
        raw.unpersist()
    return result | {"steps": steps}
