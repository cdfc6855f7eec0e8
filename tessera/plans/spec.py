"""Declarative specifications of an analysis and of its robustness checks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from tessera.errors import EngineError
from tessera.functions.formula import canonical, fields, parse, substitute

KINDS = ("drop_controls", "exclude_years", "monotone_only", "alt_outcome", "add_controls")


@dataclass(frozen=True)
class Check:
    id: str
    kind: str
    args: dict = field(default_factory=dict)
    change: str = ""


@dataclass(frozen=True)
class Rules:
    """What makes a result supportive."""

    expected_sign: int = 1
    alpha: float = 0.05
    pretrend_alpha: float = 0.10
    robustness_share: float = 0.75
    permutation_alpha: float = 0.05


@dataclass(frozen=True)
class Spec:
    unit: str
    time: str
    outcome: str
    treatment: str
    controls: tuple[str, ...] = ()
    method_family: str = "policy_causal"
    fe: tuple[str, ...] = ("unit", "time")
    cluster: str = "unit"
    bins: tuple[int, ...] = (-5, -4, -3, -2, 0, 1, 2, 3, 4, 5)
    filters: tuple[tuple, ...] = ()
    robustness: tuple[Check, ...] = ()
    permutation_n: int = 499
    permutation_seed: int = 42
    mechanism: str | None = None
    moderator: str | None = None

    def __post_init__(self) -> None:
        if not 19 <= self.permutation_n <= 1999:
            raise EngineError("invalid_spec", "19 to 1999 permutations")
        whole = sorted([*self.bins, -1])
        if whole != list(range(whole[0], whole[-1] + 1)) or whole[0] < -20 or whole[-1] > 20 or -1 in self.bins or whole[0] >= -1 or whole[-1] < 0:
            raise EngineError("invalid_spec", "event bins are consecutive within -20 to 20, leave out -1 only and lie on both sides")

    @property
    def target_outcome(self) -> str:
        """A mechanism without moderator takes the outcome's place."""
        return self.mechanism if self.method_family == "mechanism_boundary" and not self.moderator and self.mechanism else self.outcome


def compile_check(check: Check, controls: list[str], aliases: dict[str, str], known: set[str] | None = None) -> Check:
    """The check with aliases replaced by fields and formulas; arguments that make no sense, or
    no difference, are errors. ``controls``: of the base model, compiled."""

    def expression(text: object) -> str:
        if not isinstance(text, str) or not text:
            raise EngineError("robustness_args", f"{check.change or check.id}: a variable is a text")
        out = substitute(text, aliases)
        if known is not None and (unknown := fields(parse(out)) - known):
            raise EngineError("robustness_args", f"{check.change or check.id}: unknown fields {sorted(unknown)}")
        return out

    base, args = {canonical(c) for c in controls}, dict(check.args)
    if check.kind not in KINDS:
        raise EngineError("robustness_args", f"unknown kind {check.kind}")
    if check.kind in ("drop_controls", "add_controls"):
        values = args.get("controls")
        if check.kind == "drop_controls" and values is None:
            return replace(check, args={"controls": list(controls)})
        if not isinstance(values, list) or (not values and (check.kind == "add_controls" or controls)):
            raise EngineError("robustness_args", f"{check.change or check.id}: controls is a list of variables")
        values = [expression(v) for v in values]
        keys = {canonical(v) for v in values}
        if check.kind == "add_controls" and keys & base:
            raise EngineError("robustness_args", f"{check.change or check.id}: a control of the base model can't be added")
        if check.kind == "drop_controls" and not keys <= base:
            raise EngineError("robustness_args", f"{check.change or check.id}: only controls of the base model can be dropped")
        args = {"controls": values}
    elif check.kind == "alt_outcome":
        args = {"outcome": expression(args.get("outcome"))}
    elif check.kind == "exclude_years":
        years = args.get("years")
        if not isinstance(years, list) or not years or any(type(y) not in (int, float) or y != y or abs(y) == float("inf") for y in years):
            raise EngineError("robustness_args", f"{check.change or check.id}: years is a list of finite numbers")
    return replace(check, args=args)


def compile_spec(roles: dict[str, list[str]], binding: dict[str, str], checks: list[Check] = (), **options) -> Spec:
    """From role names (outcome, treatment, unit, time once each; control, mechanism, moderator
    any number) and a binding of names to fields or formulas to an executable specification."""
    for role in ("outcome", "treatment", "unit", "time"):
        if len(roles.get(role, [])) != 1:
            raise EngineError("invalid_plan", f"one {role} is needed")
    names = [n for r in roles.values() for n in r]
    if absent := [n for n in names if n not in binding]:
        raise EngineError("missing_binding", f"no binding for {', '.join(absent)}")
    if len(set(names)) != len(names):
        raise EngineError("invalid_plan", "names are used once")
    one = lambda role: binding[roles[role][0]] if roles.get(role) else None
    controls = [binding[n] for n in roles.get("control", [])]
    compiled = tuple(compile_check(c, controls, binding) for c in checks)
    return Spec(unit=one("unit"), time=one("time"), outcome=one("outcome"), treatment=one("treatment"), controls=tuple(controls), mechanism=one("mechanism"), moderator=one("moderator"), robustness=compiled, **options)


def field_semantics(text: str, semantics: dict[str, str]) -> str:
    """real_assignment if all fields of a formula are; peer_exposure if any is; else unknown."""
    used = {text} if text in semantics else fields(parse(text))
    found = {semantics.get(f, "unknown") for f in used}
    return "real_assignment" if found == {"real_assignment"} else "peer_exposure" if "peer_exposure" in found else "unknown"
