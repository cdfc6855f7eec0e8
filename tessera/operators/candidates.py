"""Research candidates: how testable they are, which one is recommended, how cards are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import ranked

# What a model is shown of the evidence.
MOST_CARDS, CANDIDATE_CHARS, PROPOSAL_CHARS = 80, 1200, 800


def testability() -> Column:
    """10 to 98: more evidence, a stated identification, a feasible position, fewer risks."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    stated = F.when(F.coalesce(F.col("identification"), F.lit("")) != "", 12).otherwise(0)
    place = F.when(F.col("positioning") == "feasible_limited_increment", 8).when(F.col("positioning") == "balanced", 4).otherwise(0)
    score = 45 + F.least(F.lit(4), size("evidence_ids")) * 8 + stated + place - F.least(F.lit(4), size("risks")) * 4
    return F.greatest(F.lit(10), F.least(F.lit(98), score)).cast("int")


def recommended(candidates: DataFrame) -> DataFrame:
    """One candidate of each set, with its score: one that the recommendation names by the first
    eight characters of its title, else the most testable; of several the first in order (seq)."""
    named = (F.col("title") != "") & F.contains("recommendation_text", F.substring("title", 1, 8))
    scored = candidates.withColumn("score", testability())
    w = Window.partitionBy("set_id").orderBy(F.desc(F.coalesce(named, F.lit(False))), F.when(F.coalesce(named, F.lit(False)), F.lit(0)).otherwise(-F.col("score")), "seq")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked_cards(cards: DataFrame, text: Column, terms: list[str]) -> DataFrame:
    """Cards with hit_ratio, the share of terms in their text, and place: included ones first,
    then by ratio, then as before (position)."""
    low = F.lower(text)
    terms = [t for t in (x.strip().lower() for x in terms) if t]
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    scored = cards.withColumn("hit_ratio", hits / F.lit(float(len(terms))) if terms else F.lit(0.0))
    return ranked(scored, ["project_id"], [F.desc("included"), F.desc("hit_ratio"), F.asc("position")], "place")


def evidence_context(cards: DataFrame, longest: int, most: int = MOST_CARDS) -> DataFrame:
    """project_id, place, id, title, year, abstract: the first cards (position) of each project that
    are included, with the abstract, or else the excerpt, cut to ``longest`` characters."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("position"))
    text = F.coalesce(F.nullif("abstract", F.lit("")), F.nullif("fulltext_excerpt", F.lit("")), F.lit(""))
    return cards.where("included").withColumn("place", place).where(F.col("place") <= most).select("project_id", "place", "id", "title", "year", F.substring(text, 1, longest).alias("abstract"))


def direction_card(directions: DataFrame) -> DataFrame:
    """Parts of a direction (id, constraints): variables, keywords, region, period, claim, data
    and other lines."""
    lines = F.filter(F.transform(F.coalesce("constraints", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    parts = {"variables": "变量：", "keywords": "关键词：", "region": "地区：", "period": "时间：", "claim": "结论类型：", "data": "数据："}
    last = lambda p: F.element_at(F.filter("lines", lambda x: x.startswith(p)), -1)
    rest = lambda p: F.substring(F.coalesce(F.when(F.exists("lines", lambda x: x.startswith(p)), last(p)), F.lit("")), len(p) + 1, 1 << 30)
    listed = lambda c: F.filter(F.transform(F.split(c, "[、,，;；]"), lambda x: F.trim(x)), lambda x: x != "")
    other = F.filter("lines", lambda x: ~x.rlike("^(" + "|".join(parts.values()) + ")"))
    d = directions.withColumn("lines", lines)
    return d.select("id", *[(listed(rest(p)) if n in ("variables", "keywords") else rest(p)).alias(n) for n, p in parts.items()], other.alias("other"))
