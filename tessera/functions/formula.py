"""A whitelist formula language that compiles to Columns: + - * /, signs, log, log1p, fields.

Inside a formula numbers follow IEEE 754 (1 / 0 is infinite and 1 / (1 / 0) is 0); only the final
value is cleaned to NULL. The text is parsed to a tree and every node is checked; nothing of it
is ever handed to Spark's SQL parser.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions.numbers import finite, ieee, numeric

LONGEST, MOST_NODES = 500, 64
INF, NAN = float("inf"), float("nan")


def divide(a: Column, b: Column) -> Column:
    """IEEE division without an error at zero."""
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, at_zero).otherwise(a / b)


def log(x: Column) -> Column:
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), F.lit(NAN)).when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def log1p(x: Column) -> Column:
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), F.lit(NAN)).when(x > -1, F.log1p(x)).when(x == -1, F.lit(-INF)).otherwise(F.lit(NAN))


FUNCTIONS: dict[str, Callable[[Column], Column]] = {"log": log, "log1p": log1p}
_NUMBERS = {"log": lambda x: math.log(x) if x > 0 else -INF if x == 0 else NAN, "log1p": lambda x: math.log1p(x) if x > -1 else -INF if x == -1 else NAN}


def parse(text: str) -> ast.expr:
    """The checked tree of a formula."""
    if not isinstance(text, str) or not text or len(text) > LONGEST:
        raise EngineError("invalid_formula", f"a formula has 1 to {LONGEST} characters")
    try:
        tree = ast.parse(text, mode="eval")
    except (SyntaxError, RecursionError, ValueError) as e:
        raise EngineError("invalid_formula", "the formula can't be parsed") from e
    nodes = list(ast.walk(tree))
    if len(nodes) > MOST_NODES:
        raise EngineError("invalid_formula", f"the formula has more than {MOST_NODES} parts")
    heads = {id(n.func) for n in nodes if isinstance(n, ast.Call)}
    for n in nodes:
        good = isinstance(n, (ast.Expression, ast.Load, ast.BinOp, ast.UnaryOp, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.UAdd, ast.USub, ast.Name))
        if isinstance(n, ast.Constant):
            good = type(n.value) in (int, float) and _is_finite(n.value)
        elif isinstance(n, ast.Call):
            good = isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS and len(n.args) == 1 and not n.keywords and not isinstance(n.args[0], ast.Starred)
        if not good and id(n) not in heads:
            raise EngineError("invalid_formula", "only fields, numbers, log, log1p and + - * / are allowed")
    return tree.body


def _is_finite(value: float) -> bool:
    try:
        return math.isfinite(float(value))
    except OverflowError:
        return False


def fields(tree: ast.expr) -> set[str]:
    heads = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in heads}


def formula(df: DataFrame, text: str) -> Column:
    """The formula over the columns of ``df``, as finite double or NULL."""
    tree = parse(text)
    used = fields(tree)
    if not used:
        raise EngineError("invalid_formula", "a formula refers to at least one field")
    for name in sorted(used):
        if name not in df.columns:
            raise EngineError("missing_field", f"no field {name}")
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def build(n: ast.expr) -> Column | float:
        if isinstance(n, ast.Name):
            return ieee(F.col(n.id), kinds[n.id])
        if isinstance(n, ast.Constant):
            return float(n.value)
        if isinstance(n, ast.UnaryOp):
            x = build(n.operand)
            return -x if isinstance(n.op, ast.USub) else x
        if isinstance(n, ast.Call):
            x = build(n.args[0])
            return _NUMBERS[n.func.id](x) if isinstance(x, float) else FUNCTIONS[n.func.id](x)
        a, b = build(n.left), build(n.right)
        if isinstance(n.op, ast.Div):
            if isinstance(a, float) and isinstance(b, float):
                if b == 0:
                    raise EngineError("invalid_formula", "division of constants by zero")
                return a / b
            return divide(a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))
        return a + b if isinstance(n.op, ast.Add) else a - b if isinstance(n.op, ast.Sub) else a * b

    return finite(build(tree))


def resolve(df: DataFrame, text: str) -> Column:
    """A field if the text is the name of one, else a formula; as finite double or NULL."""
    return numeric(df, text) if text in df.columns else formula(df, text)


def _shape(n: ast.AST | list | object) -> str:
    """What ast.dump tells of a tree, without names of fields; contexts follow from where a name stands."""
    if isinstance(n, ast.AST):
        return f"{type(n).__name__}({','.join([_shape(getattr(n, f, None)) for f in n._fields if f != 'ctx'])})"
    return f"[{','.join(map(_shape, n))}]" if isinstance(n, list) else repr(n)


def canonical(text: str) -> str:
    """Text that is equal for formulas of equal structure; white space doesn't count."""
    try:
        return _shape(ast.parse(text, mode="eval").body)
    except (SyntaxError, RecursionError, ValueError) as e:
        raise EngineError("robustness_args", "the formula can't be parsed") from e


def substitute(text: str, names: Mapping[str, str]) -> str:
    """The formula with aliases replaced, once, by their fields or formulas; function names are
    not aliases."""
    tree = parse(text)

    def swap(n: ast.expr) -> ast.expr:
        if isinstance(n, ast.Name):
            return ast.parse(names[n.id], mode="eval").body if names.get(n.id) else n
        if isinstance(n, ast.Call):
            return ast.Call(n.func, [swap(x) for x in n.args], [])
        if isinstance(n, ast.UnaryOp):
            return ast.UnaryOp(n.op, swap(n.operand))
        if isinstance(n, ast.BinOp):
            return ast.BinOp(swap(n.left), n.op, swap(n.right))
        return n

    out = ast.unparse(swap(tree))
    parse(out)
    return out
