"""Phrase collocations: frequent phrases of two to four words, scored against their parts.

Words that are frequent in their language are dictionary-encoded; pieces of text break at the others,
as no frequent phrase holds an infrequent word. The up to four ids from each place are packed into one
key of fixed width. Keys are dealt out by ranges, radix-sorted and run-length counted: runs of equal
first words are the counts of phrases of every length, so one key a place does for all of them.

Nothing is broadcast. Each block of text is first encoded with a dictionary of its own, in
one pass; the blocks' dictionaries are summed up for the counts of words, joined with the ids, and sent
back to their blocks, so a word moves once a block, however often it stands there. Ranges come from the
counts of words: a key's place among all is about the share of words before its first, plus that
word's share times the place of the rest. This grows with the key, so ranges follow the order; where
phrases are more frequent than their words suggest, ranges are uneven, but equal keys of a block are
counted before they move. A run that a border may have cut is added up afterwards.

Defined results: a null text is empty; a null lang is ``und`` and joins those of that name; repeated
rows count as often as they stand; pieces don't cross documents; texts are read whole; without any
frequent phrase there are no rows, as for an empty table. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textnum as t
from tessera.llm.ranking import n_buckets, prefix
from tessera.llm.shared import by_runs
from tessera.operators.tables import written

#: What ends a piece, and what ends a word.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", 10, 11, 12, 13]] = True
WORD_END = PIECE_END.copy()
WORD_END[[9, 32]] = True
BLOCK = 4 << 20  # bytes of text that share a dictionary
RANGE = 2_000_000  # keys that a range is made for
LONGEST = 4
IDS = ["a", "b", "c", "d"]
SALTS = 64

BLOCKS = "block string, lang string, words array<string>, counts array<long>, tokens long, codes binary"


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned numbers below 2^32, byte by byte, which compresses well."""
    return b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)


def unpacked(data: bytes, columns: int) -> np.ndarray:
    """What was packed, a row for each column."""
    planes = np.frombuffer(data, np.uint8).reshape(columns, 4, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(columns, -1)


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of keys whose parts, most significant first, are unsigned numbers below 2^32: stable passes
    by 16-bit digits from the last, which numpy does by counting."""
    order = None
    for column in reversed(columns):
        for shift in (0, 16):
            digit = (column >> shift & 0xFFFF).astype(np.uint16)
            if len(digit) and digit.min() == digit.max():
                continue
            turn = np.argsort(digit if order is None else digit[order], kind="stable")
            order = turn if order is None else order[turn]
    return np.arange(len(columns[0])) if order is None else order


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCKS from (lang, text). codes: number of the word in the block's dictionary, twice,
    plus one where a piece begins."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        of = langs.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            for _, _, data, off in t.column_blocks(batch.column(1).filter(pa.array(of == k)), BLOCK):
                start, end, first = t.words(data, off, WORD_END)
                if not len(start):
                    continue
                ends = np.r_[0, np.cumsum(end - start)]
                flat = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(t.LOWER[data[~WORD_END[data]]])])
                coded = flat.dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                pieces = np.cumsum(PIECE_END[data])[start]
                new = np.r_[True, pieces[1:] != pieces[:-1]]
                new[first[:-1][first[:-1] < len(start)]] = True
                words = coded.dictionary.cast(pa.string())
                one = pa.array([0, len(words)], pa.int32())
                counts = pa.array(np.bincount(code, minlength=len(words)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), pa.array([lang]), pa.ListArray.from_arrays(one, words), pa.ListArray.from_arrays(one, counts), pa.array([len(start)], pa.int64()), pa.array([packed([code.astype(np.uint32) * 2 + new])], pa.binary())],
                    ["block", "lang", "words", "counts", "tokens", "codes"],
                )


def _runs(columns: list[np.ndarray], *breaks: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows in order; ``breaks`` start runs as well."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    for b in breaks:
        new |= b
    return np.flatnonzero(new)


def _keys(total: int, parts: int):
    """part, keys from (codes, known): the distinct keys of a block, in order, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, codes = batch.column(1), batch.column(0)
            for r in range(batch.num_rows):
                code = unpacked(codes[r].as_py(), 1)[0]
                own = known[r].values
                at, ident, before, count = (own.field(c).to_numpy(zero_copy_only=False) for c in ("at", "id", "before", "f"))
                turn = np.argsort(ident)
                ident, before, count = (np.r_[0, x[turn]] for x in (ident, before, count))
                rank = np.zeros(int((code >> 1).max()) + 1, np.uint32)
                rank[at[turn]] = np.arange(1, len(ident))  # in order of ids, and narrower
                word, joined = rank[code >> 1], np.r_[code[1:] & 1 == 0, False]
                place = [word]
                for _ in range(1, LONGEST):
                    follows = np.r_[place[-1][1:], np.uint32(0)]
                    place.append(np.where(joined, follows, np.uint32(0)))
                for k in range(2, LONGEST):  # nothing behind an infrequent word
                    place[k] = np.where(place[k - 1] > 0, place[k], np.uint32(0))
                keep = (place[0] > 0) & (place[1] > 0)
                place = [p[keep] for p in place]
                if not len(place[0]):
                    continue
                order = radix_order(place)
                place = [p[order] for p in place]
                start = _runs(place)
                n = np.diff(np.r_[start, len(place[0])])
                place = [p[start] for p in place]
                share = np.zeros(len(start))
                for p in reversed(place):
                    share = np.where(p > 0, before[p] + count[p] * (share / total), 0.0)
                part = np.minimum((share * (parts / total)).astype(np.int64), parts - 1)
                cut = np.r_[_runs([part]), len(part)]
                ids = [ident[p] for p in place]
                rows = [packed([x[i:j] for x in (*ids, n)]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array(rows, pa.binary())], ["part", "keys"])

    return run


def _counted(least: int):
    """a, b, c, d, f for the runs of equal phrases in a range that are frequent, or that its borders may
    have cut."""

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = [unpacked(x.as_py(), LONGEST + 1) for x in table.column("keys")]
        part = np.repeat(table.column("part").to_numpy(), [x.shape[1] for x in rows])
        *ids, n = np.concatenate(rows, axis=1)
        order = radix_order([part.astype(np.uint32), *ids])
        part, n, ids = part[order], n[order].astype(np.int64), [x[order] for x in ids]
        border = np.r_[True, part[1:] != part[:-1]]
        last = np.r_[border[1:], True]
        for size in range(2, LONGEST + 1):
            start = _runs(ids[:size], border)
            end = np.r_[start[1:], len(n)]
            f = np.add.reduceat(n, start)
            good = np.flatnonzero(((f >= least) | border[start] | last[end - 1]) & (ids[size - 1][start] > 0))
            own = [x[start[good]].astype(np.int32) if k < size else np.zeros(len(good), np.int32) for k, x in enumerate(ids)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(f[good])], [*IDS, "f"])

    return by_runs("part", handle, 1)


def dictionary(seen: DataFrame, least: int) -> DataFrame:
    """lang, word, f, id (from 1, without gaps), before (the sum of f of smaller ids) and total (of
    all) of the words that a language has ``least`` times; seen: lang, word, n."""
    frequent = written(seen.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "frequent")
    keyed = frequent.withColumns({"_all": F.lit(0), "_b": F.pmod(F.xxhash64("lang", "word"), F.lit(n_buckets(seen.sparkSession)))})
    numbered = prefix(keyed, ["_all"], "_b", [F.col("lang"), F.col("word")], F.lit(1), "id", "_n")
    numbered = prefix(numbered, ["_all"], "_b", [F.col("lang"), F.col("word")], F.col("f"), "_upto", "total")
    return written(numbered.select("lang", "word", "f", F.col("id").cast("int").alias("id"), (F.col("_upto") - F.col("f")).alias("before"), "total"), "dictionary")


def frequent_phrases(docs: DataFrame, least: int = 30, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """a, b, c, d, f: ids of the words of all phrases of two to four words that a language has
    ``least`` times, 0 where there are fewer; the dictionary; and lang, n, the words of each language."""
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    blocks = written(plain.mapInArrow(_encoded, BLOCKS), "blocks")
    sizes = blocks.groupBy("lang").agg(F.sum("tokens").alias("n"))
    seen = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("block", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = dictionary(seen, least)
    total = (words.select("total").first() or [1])[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    known = seen.join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("at", "id", "before", "f")).alias("known"))
    keys = blocks.select("block", "codes").join(known, "block").select("codes", "known").mapInArrow(_keys(total, parts), "part int, keys binary")
    counted = keys.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(_counted(least), "a int, b int, c int, d int, f long")
    return written(counted.groupBy(*IDS).agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases"), words, sizes


def _size() -> Column:
    return F.when(F.col("d") > 0, 4).when(F.col("c") > 0, 3).otherwise(2)


def _part(first: Column, n: Column) -> list[Column]:
    """The ids of the n words of a phrase from the one numbered ``first`` (from 0), padded."""
    ids = F.array(*IDS)
    return [F.when(n > k, F.get(ids, first + k)).otherwise(0) for k in range(LONGEST)]


def _looked_up(df: DataFrame, freq: DataFrame, ids: list[Column], out: str) -> DataFrame:
    keyed = df.withColumns({f"_{c}": x for c, x in zip(IDS, ids, strict=True)})
    return keyed.join(freq.select(*[F.col(c).alias(f"_{c}") for c in IDS], F.col("f").alias(out)), [f"_{c}" for c in IDS]).drop(*[f"_{c}" for c in IDS])


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """a, b, c, d, f with l, r and score of the cut that scores lowest, the first of equal ones."""
    freq = phrases.unionByName(words.select(F.col("id").alias("a"), *[F.lit(0).alias(c) for c in IDS[1:]], "f"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), _size() - 1)))
    cuts = _looked_up(cuts, freq, _part(F.lit(0), F.col("k")), "l")
    cuts = _looked_up(cuts, freq, _part(F.col("k"), _size() - F.col("k")), "r")
    score = F.expr("(cast(f AS decimal(20, 0)) * 2000000) div (cast(l AS decimal(20, 0)) + r)")
    best = cuts.withColumn("score", score).groupBy(*IDS, "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select(*IDS, "f", "cut.l", "cut.r", "cut.score")


def standing_alone(phrases: DataFrame, of: DataFrame, percent: int = 80) -> DataFrame:
    """Rows of ``of`` without phrases that a longer one of ``phrases`` holds which is at least
    ``percent`` as frequent."""
    size = _size()
    inner = [(first, n) for n in (2, 3) for first in range(LONGEST - n + 1)]
    parts = F.array(*[F.when((size > n) & (size >= first + n), F.struct(*[x.alias(c) for x, c in zip(_part(F.lit(first), F.lit(n)), IDS, strict=True)])) for first, n in inner])
    longer = phrases.where("c > 0").select("f", F.explode(parts).alias("p")).where("p is not null").groupBy(*[F.col(f"p.{c}").alias(c) for c in IDS]).agg(F.max("f").alias("_longer"))
    kept = of.join(longer, IDS, "left")
    return kept.where(F.col("_longer").isNull() | F.expr(f"cast(_longer AS decimal(20, 0)) * 100 < cast(f AS decimal(20, 0)) * {int(percent)}")).drop("_longer")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80, **columns) -> DataFrame:
    """lang, rank, phrase, a (its count), l, r (those of its parts), n (words of the language) and score
    of the ``top`` phrases of each language."""
    phrases, words, sizes = frequent_phrases(docs, least, **columns)
    best = standing_alone(phrases, scored(phrases, words), percent)
    spelt = best.select("*", F.posexplode(F.array(*IDS)).alias("at", "id")).where("id > 0").join(words.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy(*IDS, "f", "l", "r", "score").agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    # a language may hold most phrases: the best of each share of it first
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    heads = spelt.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    heads = heads.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("_r") <= top)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


#: The same from lists of the words of each piece; parts and longer phrases are found by their spelling.
ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
g0 AS (SELECT lang, k.range AS m, w, unnest(range(1, len(w) - k.range + 2)) AS i FROM p, range(1, 5) k WHERE len(w) >= k.range),
g AS MATERIALIZED (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM g0 GROUP BY 1, 2, 3 HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m >= 2),
k AS MATERIALIZED (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.m, k.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM k JOIN g x ON x.lang = k.lang AND x.phrase = head JOIN g y ON y.lang = k.lang AND y.phrase = rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100::HUGEINT * c.a >= 80::HUGEINT * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o JOIN t USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
