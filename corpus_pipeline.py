"""From raw documents to training shards: language, near-duplicates, test leaks, mixture, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's docs. All but the last return the columns of documents.

Defined results, for all stages: an empty table gives an empty one; texts are read whole, however
long; nulls in any column are allowed, a null id being an id of its own and a null source a source
of its own; further columns are carried along, also those named like a column that a stage makes
for itself, but for shard and slot, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, langid, mixing, ngram_join, sharding
from tessera.llm.shared import fresh
from tessera.operators.tables import written
from tessera.tables import table

SHARDS = 24
#: A document whose best language is less likely than this is rejected, as is one without letters.
LANGUAGE_SCORE = 0.34

#: The stages hold a trained network and banded joins, which SQL can't express.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the network knows, by the network trained on those with
    a language. Null and empty texts, and texts without letters, go; repeated rows are judged
    alike; without any known language nothing can be kept. Ties go to the first language by name."""
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    tagged = langid.predict(docs, langid.train(docs), lang_out=lang, score_out=score)
    return tagged.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= LANGUAGE_SCORE)).drop(lang, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: the smallest id, nulls last, of equal ones
    the smaller hash of the text. Texts of fewer than five words are near only to texts of the same
    words; repeated rows are one class; texts without words, as null ones, have none and stay."""
    return ngram_join.keep_one(docs)


def test_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents into which no benchmark item leaked. Null and empty texts, and all texts
    if the benchmark is empty, are clean; repeated rows are judged alike."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the source weights ask, 0 to 2 times and whole. Documents without
    words are never taken, as they have no size; of rows that tie, as repeated ones, either may be
    taken, and the result is the same."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every row its shard (0 to 23) and slot (gapless from 0); counts differ by one at most.
    Repeated rows are interchangeable."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("test_leaks", test_leaks), ("mixture", mixture), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
