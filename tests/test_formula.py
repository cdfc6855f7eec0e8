from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions.formula import canonical, formula, resolve, substitute
from tessera.functions.numbers import numeric


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1.0, "2", 0.0, 3), (None, " 1e3 ", 4.0, -1), (float("inf"), "1d", -2.0, 0), (float("nan"), "x", 1.0, 7)], "a double, s string, z double, i int")


def values(df, text):
    return [r[0] for r in df.select(formula(df, text)).collect()]


def test_values_follow_ieee_inside(df):
    assert values(df, "a + 2 * i") == [7.0, None, None, None]
    assert values(df, "1 / z") == [None, 0.25, -0.5, 1.0]
    assert values(df, "1 / (1 / z)") == [0.0, 4.0, -2.0, 1.0]
    assert values(df, "1 / log(z)")[0] == 0.0 and values(df, "log(z)") == [None, math.log(4), None, 0.0]
    assert values(df, "log1p(i)") == [math.log1p(3), None, 0.0, math.log1p(7)]
    assert values(df, "-s") == [-2.0, -1000.0, None, None]


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "a[0]", "log(a, 2)", "a ** 2", "True", "1 + 2", "", "a" * 501, "a if a else a", "1/0 + a", "log", "a + " * 20 + "a"])
def test_anything_else_is_rejected(df, text):
    with pytest.raises(EngineError):
        formula(df, text)


def test_missing_field_and_name_first(spark, df):
    with pytest.raises(EngineError, match="missing_field"):
        formula(df, "nope + 1")
    odd = spark.createDataFrame([(5.0,)], ["a"])
    assert odd.select(resolve(odd, "a")).first()[0] == 5.0


def test_canonical_and_aliases():
    assert canonical("a+b") == canonical(" a + b ".strip()) != canonical("b + a")
    assert substitute("log(size) + log", {"size": "assets + 1", "log": "x"}) == "log(assets + 1) + x"


def test_numeric_coercion(spark):
    d = spark.createDataFrame([("1",), ("1.0f",), ("inf",), ("-.5e1",), ("",), (None,)], "s string")
    assert [r[0] for r in d.select(numeric(d, "s")).collect()] == [1.0, None, None, -5.0, None, None]
    b = spark.createDataFrame([(True,)], "b boolean")
    assert b.select(numeric(b, "b")).first()[0] == 1.0 and b.select(F.lit(1)).count() == 1


def test_canonical_texts_differ_as_trees_do():
    import ast

    texts = ["a+b", " a + b", "b+a", "a+b*2", "(a+b)*2", "a+(b*2)", "1", "1.0", "-1", "+1", "f(a)", "f(a, b)", "f(a, k=b)", "f(*a)", "'1'", "b'1'", "u'1'", "a.b", "a[1]", "a < b < c", "lambda x: x", "[a, b]", "(a, b)", "{1: a}", "True", "None", "x if y else z"]
    trees = [ast.dump(ast.parse(t.strip(), mode="eval")) for t in texts]
    shapes = [canonical(t.strip()) for t in texts]
    assert [[a == b for b in trees] for a in trees] == [[a == b for b in shapes] for a in shapes]
