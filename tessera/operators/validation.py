"""Checks of rows that come from outside: each adds an array of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What fields may hold.
NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"
FAMILIES = ["policy_causal", "panel_association", "mechanism_boundary"]
ROLES = ["outcome", "treatment", "unit", "time", "control", "mechanism", "moderator"]
SINGLE_ROLES = ["outcome", "treatment", "unit", "time"]
SEMANTICS = ["real_assignment", "peer_exposure", "unknown"]
LEVELS = ["firm", "industry", "region", "other"]
MOST_QUERIES, LONGEST_TITLE, YEARS = 6, 2000, (1000, 2200)


def _wrong(**tests: Column) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), name) for name, good in tests.items()]))


def check_plans(plans: DataFrame) -> DataFrame:
    """Plans (method_family, variables: array of role and name, robustness and claims: arrays of
    id, boundary_notes, binding: map)."""
    names = F.transform("variables", lambda v: v["name"])
    unique = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    ids = lambda c: F.transform(c, lambda x: x["id"])
    held = F.transform("variables", lambda v: v["role"])
    roles = {f"{r}_once": F.size(held) - F.size(F.array_remove(held, r)) == 1 for r in SINGLE_ROLES}
    bound = F.col("binding").isNull() | (F.size(F.array_except(F.map_keys("binding"), names)) == 0)
    return plans.withColumn("problems", _wrong(method_family=F.col("method_family").isin(FAMILIES), variables=(F.size("variables") >= 4) & F.forall("variables", lambda v: v["role"].isin(ROLES) & v["name"].rlike(NAME)), names_unique=unique(names), **roles, robustness_unique=unique(ids("robustness")), claims=(F.size("claims") >= 1) & unique(ids("claims")), boundary_notes=F.length("boundary_notes") > 0, binding=bound))


def check_queries(searches: DataFrame) -> DataFrame:
    """Searches (queries: array of texts): one to six, none empty."""
    return searches.withColumn("problems", _wrong(count=F.size("queries").between(1, MOST_QUERIES), text=F.forall("queries", lambda q: F.length(F.trim(q)) > 0)))


def check_patches(patches: DataFrame) -> DataFrame:
    """Changes of evidence (title, year), where given."""
    return patches.withColumn("problems", _wrong(title=F.col("title").isNull() | F.length("title").between(1, LONGEST_TITLE), year=F.col("year").isNull() | F.col("year").between(*YEARS)))


def check_fields(fields: DataFrame) -> DataFrame:
    """Annotations of fields (semantics, level)."""
    return fields.withColumn("problems", _wrong(semantics=F.col("semantics").isin(SEMANTICS), level=F.col("level").isin(LEVELS)))


def valid(df: DataFrame) -> DataFrame:
    return df.where(F.size("problems") == 0)
