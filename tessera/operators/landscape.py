"""What a corpus of records looks like: years, venues, keywords, their graph, methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.fixed_values import CHINESE_TERMS, METHODS, STOPWORDS

TOP_KEYWORDS, TOP_VENUES, TOP_EDGES, TOP_CITED = 18, 10, 50, 5


def keywords(title: Column, concepts: Column) -> Column:
    """Sorted keywords: concepts and known terms in the title; words of the title only where
    there are no concepts."""
    title = F.lower(F.coalesce(title, F.lit("")))
    concepts = F.coalesce(concepts, F.array().cast("array<string>"))
    own = F.filter(F.transform(concepts, lambda c: F.lower(F.trim(c))), lambda c: c != "")
    known = F.filter(F.array(*[F.lit(t) for t in CHINESE_TERMS]), lambda t: F.contains(title, t))
    words = F.array_except(F.regexp_extract_all(title, F.lit(r"[a-z][a-z-]{3,}"), 0), F.array(*[F.lit(w) for w in STOPWORDS]))
    return F.array_sort(F.array_union(F.array_union(own, known), F.when(F.size(concepts) == 0, words).otherwise(F.array().cast("array<string>"))))


def keyword_rows(records: DataFrame) -> DataFrame:
    """position, at (place among the record's keywords), term. Needs position, title, concepts."""
    return records.select("position", F.posexplode(keywords(F.col("title"), F.col("concepts"))).alias("at", "term"))


def top_keywords(terms: DataFrame, top: int = TOP_KEYWORDS) -> DataFrame:
    """term, count; of equal counts the term that appears first comes first."""
    counted = terms.groupBy("term").agg(F.count("*").alias("count"), F.min(F.struct("position", "at")).alias("first"))
    return counted.orderBy(F.desc("count"), "first").limit(top).select("term", "count")


def keyword_edges(terms: DataFrame, top: int = TOP_EDGES, keywords: int = TOP_KEYWORDS) -> DataFrame:
    """source < target, count: how many records have both of two top keywords.

    Only top keywords take part, so a record makes few pairs and the graph is small."""
    head = top_keywords(terms, keywords).select("term")
    few = terms.join(F.broadcast(head), "term").select("position", "at", "term")  # at most TOP_KEYWORDS rows
    listed = few.groupBy("position").agg(F.array_sort(F.collect_set("term")).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.filter("t", lambda b: b > a), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    each = listed.select("position", F.posexplode(pairs).alias("at", "pair")).select("position", "at", "pair.*")
    counted = each.groupBy("source", "target").agg(F.count("*").alias("count"), F.min(F.struct("position", "at")).alias("first"))
    return counted.orderBy(F.desc("count"), "first").limit(top).select("source", "target", "count")


def method_counts(records: DataFrame, text: Column) -> DataFrame:
    """method, n: records whose text names each method. One pass."""
    counted = records.agg(*[F.count_if(text.rlike(f"(?iU){p}")).alias(f"m{i}") for i, p in enumerate(METHODS.values())])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"m{i}").alias("n")) for i, m in enumerate(METHODS)])).alias("r")).select("r.*")


def counts(records: DataFrame, column: str) -> DataFrame:
    return records.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))


def unknown_years(records: DataFrame) -> DataFrame:
    """A year of 0 counts as unknown."""
    return records.agg(F.count_if(F.coalesce("year", F.lit(0)) == 0).alias("unknown_year"), F.count("*").alias("n_cards"))


def top_cited(records: DataFrame, top: int = TOP_CITED) -> DataFrame:
    return records.orderBy(F.desc_nulls_last("cited_by"), "position").limit(top)


def newest_first(records: DataFrame, top: int) -> DataFrame:
    """The newest records; those without a year come last, and earlier positions first in ties."""
    return records.orderBy(F.desc_nulls_last("year"), "position").limit(top)


def year_histogram(records: DataFrame, column: str, bins: int = 8) -> DataFrame:
    """bin, from_year, to_year, n: whole-year bins of equal width, at most ``bins``."""
    ends = records.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).withColumn("w", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / bins)).cast("int"))
    at = F.floor((F.col(column) - F.col("lo")) / F.col("w")).cast("int")
    rows = records.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends))
    return rows.groupBy(at.alias("bin"), "lo", "w").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * F.col("w")).cast("long").alias("from_year"), (F.col("lo") + (F.col("bin") + 1) * F.col("w") - 1).cast("long").alias("to_year"), "n")


def source_counts(records: DataFrame) -> DataFrame:
    """source, n: records that each source has (records list several)."""
    return records.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def pair_coverage(records: DataFrame, text: Column, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, n: records that mention both words of a pair."""
    low = F.lower(text)
    counted = records.agg(*[F.count_if(F.contains(low, F.lit(a.lower())) & F.contains(low, F.lit(b.lower()))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("n")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")
