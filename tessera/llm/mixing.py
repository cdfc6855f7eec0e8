"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions.

A source's target is its weighted share of the budget, cut at ``max_epochs`` times its size with
the excess shared out again (water filling). A source first gives its complete epochs, floor of
target / size times every document; the rest is filled by weighted sampling without replacement:
documents in falling order of u^(1/quality weight), u a keyed uniform hash, as long as the running
sum of sizes stays within the rest; the gap that the first document too long leaves is filled from
later ones that fit it, in the same order, to the sum nearest to it. Documents are taken whole.

Defined results: a null or empty text has size 0; a null source is a source of its own, last in
order; a source of size 0 has target 0; rows equal in id and text share a key and are taken in
either order; documents without labels weigh 1; an empty table gives no rows. Other columns are
carried along by mixed_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.ranking import attach, carry_back, n_buckets, named_back, prefix, row_key
from tessera.operators.tables import written

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5.0, 2.0, 1.0)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, quality_weight: 0.5 (label 0) to 2 (label 1), repeated labels averaged."""
    mean = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("_q"))
    return mean.select("doc_id", (0.5 + 1.5 * F.least(F.greatest("_q", F.lit(0.0)), F.lit(1.0))).alias("quality_weight"))


def source_targets(sizes: DataFrame, cycle: tuple[float, ...], budget: float, max_epochs: float) -> DataFrame:
    """sizes: one row per source (_src orders it; source_size). Adds target by water filling:
    with sources in rising order of cap / weight, each level is what is left over the weight
    that is left, all before being at their caps; the largest is the level at which none is above.
    Its windows run over the list of sources, one row each."""
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(everything.orderBy("_src")) - 1) % len(cycle) + 1).cast("int"))
    s = sizes.withColumn("_wt", weight).withColumn("_cap", max_epochs * F.col("source_size"))
    before = everything.orderBy(F.col("_cap") / F.col("_wt"), "_src").rowsBetween(Window.unboundedPreceding, -1)
    left = budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / (F.sum("_wt").over(everything) - F.coalesce(F.sum("_wt").over(before), F.lit(0.0)))
    s = s.withColumn("_level", level)
    return s.select("_src", F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("_wt")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame, keep: list[str], cycle: tuple[float, ...] = CYCLE, budget: float = 1.5, max_epochs: float = 2.0, seed: int = 29) -> DataFrame:
    """The columns ``keep`` with size, source_size, target and copies (times the mix takes the
    document). ``quality``: doc_id, quality_weight in 0.25 to 4."""
    n = n_buckets(docs.sparkSession)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    rows = docs.select(
        *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)],
        F.col("doc_id").alias("_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("~")).alias("_src"),
        words(F.col("text")).alias("size"),
        F.substring(digest, 1, 13).alias("_hex"),
    )
    rows = rows.join(quality.select(F.col("doc_id").alias("_id"), "quality_weight"), "_id", "left")
    u = (F.conv("_hex", 16, 10).cast("double") + 0.5) / float(2**52)
    # texts are read once; what follows ranks keys and sizes
    rows = written(rows.withColumn("_at", 1.0 - F.pow(u, 1.0 / F.coalesce("quality_weight", F.lit(1.0)))).withColumn("_b", F.floor(F.col("_at") * n)), "sizes")
    sizes = rows.groupBy("_src").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, cycle, budget, max_epochs)
    ranked = prefix(rows, ["_src"], "_b", [F.col("_at"), F.col("_hex")], F.col("size"), "_upto", "source_size", per_group=targets)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    order = [F.col("_at"), F.col("_hex")]
    ranked = ranked.withColumn("_epochs", epochs).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    ranked = ranked.withColumn("_first", (F.col("size") > 0) & (F.col("_upto") <= F.col("_rest")))
    gaps = ranked.groupBy("_src").agg((F.first("_rest") - F.sum(F.when(F.col("_first"), F.col("size")).otherwise(F.lit(0)))).alias("_gap"))
    ranked = attach(ranked, ["_src"], "_b", gaps)
    fits = ~F.col("_first") & (F.col("size") > 0) & (F.col("size") <= F.col("_gap"))
    ranked = prefix(ranked.withColumn("_fits", fits), ["_src"], "_b", order, F.when(F.col("_fits"), F.col("size")).otherwise(F.lit(0)), "_upto2", "_all2")
    second = F.col("_fits") & (2.0 * F.col("_upto2") - F.col("size") <= 2.0 * F.col("_gap"))
    copies = F.col("_epochs") + (F.col("_first") | second).cast("int")
    return ranked.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op6."""
    m = mix(docs, quality_weights(labels), keep=["doc_id"])
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, in the columns of ``docs``. Only
    keys and sizes are ranked, texts move once."""
    m = mix(docs.select("doc_id", "text", "source", row_key(docs).alias("_key")), quality_weights(labels), keep=["_key"])
    m = carry_back(docs, m.withColumnRenamed("copies", "_copies"), ["_copies"])
    return named_back(m.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs.columns, [])


ORACLE = r"""
WITH w AS (
  SELECT doc_id, 's' || source AS src0, coalesce('s' || source, '~') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('29:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS h
  FROM documents),
q AS (SELECT doc_id, 0.5 + 1.5 * least(greatest(avg(quality)::DOUBLE, 0.0), 1.0) AS qw FROM labels
      WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM w GROUP BY src),
s2 AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT]::DOUBLE AS wt, 2.0::DOUBLE * source_size AS cap FROM s),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER b, 0)) AS lv
       FROM s2 WINDOW b AS (ORDER BY cap / wt, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src, source_size, least(cap, max(lv) OVER () * wt) AS target FROM s3),
k AS (SELECT w.*, 1.0::DOUBLE - pow((h::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE, 1.0::DOUBLE / coalesce(qw, 1.0)::DOUBLE) AS pos FROM w LEFT JOIN q USING (doc_id)),
c AS (SELECT k.doc_id, k.src, k.size, pos, h, t.source_size, t.target, sum(size) OVER (PARTITION BY k.src ORDER BY pos, h ROWS UNBOUNDED PRECEDING) AS upto,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS ep
      FROM k JOIN t ON k.src = t.src),
f AS (SELECT *, size > 0 AND upto <= target - ep * source_size AS first FROM c),
g AS (SELECT *, target - ep * source_size - sum(CASE WHEN first THEN size ELSE 0 END) OVER (PARTITION BY src) AS gap FROM f),
m AS (SELECT *, NOT first AND size > 0 AND size <= gap AS fits FROM g),
r AS (SELECT *, sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY src ORDER BY pos, h ROWS UNBOUNDED PRECEDING) AS upto2 FROM m)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (ep + CASE WHEN first OR (fits AND 2.0::DOUBLE * upto2 - size <= 2.0::DOUBLE * gap) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
