"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of each source are put in a seeded random order; the row of rank r among n has the
fractional rank (2r - 1) / 2n. Sorting all rows by it interleaves the sources in proportion, so
every run of consecutive rows has the mixture of the whole, and equal runs are the shards.

Defined results: a null text has size 8 and no bytes to check-sum (text_crc32 0, as of the empty
text); a null source is a source of its own; rows that are equal in id and text are
interchangeable; an empty table gives no rows. Other columns are carried along; columns that are
called shard or slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ranking import carry_back, n_buckets, named_back, prefix, row_key


def places(docs: DataFrame, shards: int, keep: list[str], seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns ``keep`` with shard (0 to shards - 1, counts at most one apart) and slot
    (gapless from 0)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    n = n_buckets(docs.sparkSession)
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = docs.select(
        *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)],
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("_src"),
        key.alias("_key"),
        F.floor((F.shiftrightunsigned(key, 12).cast("double") / F.lit(float(2**52))) * n).alias("_b1"),
    )
    in_source = prefix(rows, ["_src"], "_b1", [F.shiftrightunsigned("_key", 12), F.col("_key")], F.lit(1), "_r", "_n")
    in_source = in_source.withColumn("_f", (2.0 * F.col("_r") - 1.0) / (2.0 * F.col("_n"))).withColumn("_b2", F.floor(F.col("_f") * n)).withColumn("_all", F.lit(0))
    ranked = prefix(in_source, ["_all"], "_b2", [F.col("_f"), F.col("_src"), F.col("_r")], F.lit(1), "_g", "_m")
    at, of = F.col("_g") - 1, F.col("_m")
    shard = F.expr(f"((_g - 1) * {shards}) div _m")
    first = F.expr(f"(shard * _m + {shards - 1}) div {shards}")  # the first rank that falls to the shard
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", (at - first).cast("long")).select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 24, **options) -> DataFrame:
    """``docs`` with shard and slot; only keys and sources are ranked, texts move once."""
    keyed = docs.select("doc_id", "text", "source", row_key(docs).alias("_key"))
    return named_back(carry_back(docs, places(keyed, shards, ["_key"], **options), ["shard", "slot"]), docs.columns, ["shard", "slot"])


def shard_digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The columns of op1: sizes and check sums of the text beside the place of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select("doc_id", "text", "source", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = places(facts, shards, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
