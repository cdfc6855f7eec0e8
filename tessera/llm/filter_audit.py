"""Audit of how quality filters interact: what each removes, in every order of application.

A relational word pipeline: words are exploded and aggregated by (document, word), then by document
for totals and distinct words. That meets the other flags in an outer join, and one aggregate by part
counts the 32 combinations of failures in 32 conditional columns. Everything that is asked of the 120
orders follows from these: what stands after a set of filters is the sum of the combinations that
share no filter with it.

Words depend on the text only, so the document of the word pipeline is a distinct text, told apart
by 128 bits of SHA-256: copies are combined before they are shuffled and their words counted
once. Which copy is the earliest follows from a minimum by (text, part, id), then by (text, part),
then by text, so no task holds a group of copies.

Defined results: a null text is empty and has no words, which fails A only (and E, if an empty text
has a smaller id); a null lang is the part ''; a row without id never fails E, makes no other row fail
it, and has no labels; rows repeated under one id are as early as each other; a document that is
labelled several times is good or toxic if one label says so; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import written

FILTERS = "ABCDE"
ALL = 1 << len(FILTERS)
KEY = ["k1", "k2"]
COUNTS = ["n", "good", "toxic"]


def _text_key(text: Column) -> list[Column]:
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "k1"), (17, "k2"))]


def word_counts(texts: DataFrame) -> DataFrame:
    """k1, k2, words, distinct_words of texts (k1, k2, text) that have words."""
    word = F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")
    by_word = texts.select(*KEY, word).where("word <> ''").groupBy(*KEY, "word").agg(F.count("*").alias("n"))
    return by_word.groupBy(*KEY).agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def _earliest(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """k1, k2, part, of_text (failures C and D), least (smallest id) and the counts n, good, toxic of
    all rows and of those of the least id or without one (early_n, ...)."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("long")).alias(name) for c, name in (("quality", "is_good"), ("toxic", "is_toxic"))])
    by_id = rows.groupBy(*KEY, "part", "doc_id").agg(F.count("*").alias("n"), F.max("of_text").alias("of_text"))
    # written, so that a join can split an id that is repeated very often
    known = by_id.join(written(said, "labels"), "doc_id", "left")
    known = known.withColumns({"good": F.col("n") * F.coalesce("is_good", F.lit(0)), "toxic": F.col("n") * F.coalesce("is_toxic", F.lit(0))})
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *COUNTS)))
    one = known.groupBy(*KEY, "part").agg(F.max("of_text").alias("of_text"), *[F.sum(c).alias(c) for c in COUNTS], first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    return one.select(*KEY, "part", "of_text", *COUNTS, F.col("first.doc_id").alias("least"), *[F.coalesce(f"first.{c}", F.lit(0)).alias(f"first_{c}") for c in COUNTS], "no_id")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and n_m, good_m, toxic_m for m of 0 to 31: how many documents, good and toxic ones, fail
    just the filters whose bits m has (A is 1, E is 16)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), *_text_key(text))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    of_text = (100 * capitals > 10 * F.length("text")).cast("int") * 4 + F.col("text").rlike("[#$%&*|]").cast("int") * 8
    groups = written(_earliest(plain.select(*KEY, "part", "doc_id", of_text.alias("of_text")), labels), "groups")
    counted = word_counts(plain.groupBy(*KEY).agg(F.any_value("text").alias("text")))

    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    of_words = (words < 100).cast("int") + (100 * distinct < 80 * words).cast("int") * 2
    of_key = groups.groupBy(*KEY).agg(F.min("least").alias("earliest")).join(counted, KEY, "fullouter").select(*KEY, "earliest", of_words.alias("of_words"))
    own = F.col("least") == F.col("earliest")
    mask = F.col("of_text") + F.col("of_words")
    early = {c: F.when(F.coalesce(own, F.lit(False)), F.col(f"first_{c}")).otherwise(0) + (F.col("no_id") if c == "n" else 0) for c in COUNTS}
    two = F.array(F.struct(mask.alias("m"), *[early[c].alias(c) for c in COUNTS]), F.struct((mask + 16).alias("m"), *[(F.col(c) - early[c]).alias(c) for c in COUNTS]))
    both = groups.join(of_key, KEY).select("part", F.inline(two))
    by_mask = both.groupBy("part", "m").agg(*[F.sum(c).alias(c) for c in COUNTS])  # at most 32 a part
    return by_mask.groupBy("part").agg(*[F.expr(f"sum(if(m = {m}, {c}, 0)) AS {c}_{m}") for c in COUNTS for m in range(ALL)])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step."""
    alive = {c: F.expr("array(" + ", ".join(" + ".join(f"{c}_{m}" for m in range(ALL) if not m & s) for s in range(ALL)) + ")") for c in COUNTS}
    alone = F.expr("array(" + ", ".join(f"n_{1 << f}" for f in range(len(FILTERS))) + ")")
    table = cells(docs, labels).select("part", *[alive[c].alias(f"{c}_alive") for c in COUNTS], alone.alias("alone"))

    def gain(f: int) -> str:
        """Over all orders, what the filter removes after each set of others."""
        weight = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
        return " + ".join(f"{weight(s)} * (n_alive[{s}] - n_alive[{s | 1 << f}])" for s in range(ALL) if not s >> f & 1)

    table = table.withColumn("gains", F.expr("array(" + ", ".join(gain(f) for f in range(len(FILTERS))) + ")"))
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    steps = table.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    # filters before the step, and with it
    place = [F.instr("filter_order", f) for f in FILTERS]
    steps = steps.withColumns({
        "was": sum((F.when(p < F.col("step"), 1 << f).otherwise(0) for f, p in enumerate(place)), F.lit(0)),
        "now": sum((F.when(p <= F.col("step"), 1 << f).otherwise(0) for f, p in enumerate(place)), F.lit(0)),
        "f": F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1,
    })
    lost = lambda c: F.get(f"{c}_alive", F.col("was")) - F.get(f"{c}_alive", F.col("now"))
    fails = F.get("n_alive", F.lit(0)) - F.get("n_alive", F.col("now") - F.col("was"))
    out = {"kept": F.get("n_alive", F.col("now")), "removed": lost("n"), "redundant": fails - lost("n"), "unique_fails": F.get("alone", F.col("f")), "good_lost": lost("good"), "toxic_lost": lost("toxic"), "shapley": F.get("gains", F.col("f"))}
    return steps.select("part", "filter_order", "step", *[v.cast("long").alias(k) for k, v in out.items()])


#: The same, from each document and its failures by every order.
ORACLE = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d0 AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
d1 AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS earliest FROM d0),
d2 AS (SELECT d1.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN d1.doc_id > earliest THEN 16 ELSE 0 END) AS m FROM d1 LEFT JOIN l ON d1.doc_id = l.doc_id),
c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d2 GROUP BY part, m),
f AS (SELECT chr(65 + range::INT) AS name, range AS i FROM range(5)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a, f b, f c, f d, f e WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i),
s AS (SELECT filter_order, x.range AS step, sum(CASE WHEN instr(filter_order, name) < x.range THEN 1 << i ELSE 0 END)::BIGINT AS was, sum(CASE WHEN instr(filter_order, name) = x.range THEN 1 << i ELSE 0 END)::BIGINT AS own FROM o, range(1, 6) x, f GROUP BY 1, 2),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN m & (was | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & was = 0 AND m & own > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN m & was > 0 AND m & own > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN m & was = 0 AND m & own > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN m & was = 0 AND m & own > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
