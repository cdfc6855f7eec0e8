"""Benchmark decontamination: passages query a BM25 index of test items by block-max WAND.

The items are the documents of a small inverted index: impacts are BM25 weights divided by the
item's own full score, so a score of 1 means that every term of the item is there. Postings are in
item order, in blocks of BLOCK items with their largest impact. Every passage of every training
document (windows of twice the longest item, each overlapping the next by half, so an item lies
whole in one) is a query. Block-max WAND goes through the lists of its terms: sorted by the item at
which each stands, the largest impacts are added up until they reach the threshold; the item of
that list is the pivot, and no item before it can reach the threshold. If the largest impacts of
the pivot's blocks reach it, too, the pivot is scored in full, else the lists skip to the end of the
block or to the next list's item. The passages of a block of texts take their steps together, in
numpy. Every item at or above the threshold is retrieved. A retrieved item counts as leaked when
runs of ``n`` words that passage and item share cover enough of its question and enough of its
answer.

The answer is what follows "answer:", or the last question mark; an item with neither is one part
and counts by the share of all its words. A question or answer of fewer than ``n`` words has no run
of its own: it also counts as covered where its words stand in a row within 2 ``n`` words of the
other part, outside it. Items come to the driver in portions of at most PORTION bytes of text, with
the term counts and lengths of the whole benchmark, so that results don't depend on the number of
portions; a Python worker holds HELD of them, so one pass over the documents does for 128 MB of
items, and takes about four times the items' text in memory.

Defined results: words are runs of letters and digits (ASCII case and signs don't count); an item
of fewer than ``n`` words is leaked wherever all its words stand in a row; null texts have no
passages; equal items are each reported; repeated rows are each reported. An empty benchmark
leaves every document clean. Other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textnum as t
from tessera.llm.shared import fresh
from tessera.operators.tables import written

U = np.uint64
PORTION, HELD = 8 << 20, 16
BLOCK = 16
K1, B = 1.2, 0.75
FILTER_BITS = 20
_FILTER_SHIFT = np.uint64(64 - FILTER_BITS)
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())]))


def answer_start(text: str) -> int:
    """Character at which the answer part of an item begins; the end if it marks none."""
    if m := list(re.finditer(r"(?i)\banswer\s*:", text)):
        return m[-1].end()
    return text.rstrip()[:-1].rfind("?") + 1 or len(text)


def item_words(text: str) -> tuple[np.ndarray, int]:
    """Word hashes of an item, and the number of words before its answer."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = t.words(data, np.array([0, len(data)]), t.SIGNS)
    return t.word_hashes(data, start, end), int(np.searchsorted(start, len(text[: answer_start(text)].encode())))


@dataclass
class Corpus:
    """Counts over the whole benchmark, with document frequencies of a portion's terms."""

    items: int
    words: int
    largest: int
    terms: np.ndarray  # in order
    df: np.ndarray


@dataclass
class Index:
    ids: list
    words: list[np.ndarray]
    answer: list[int]
    terms: np.ndarray
    seen: np.ndarray  # by the leading bits of a hash: whether it may be a term
    first: np.ndarray  # of each term's postings
    item: np.ndarray
    impact: np.ndarray
    posting: np.ndarray  # term and item in one number, in order
    list_max: np.ndarray
    block: np.ndarray  # term and block in one number, in order
    block_max: np.ndarray
    block_of: np.ndarray  # of each posting: the largest impact of its block
    passage: int

    @staticmethod
    def build(items: list[tuple], n: int, corpus: Corpus | None = None) -> Index | None:
        """items: (item_id, text), in any order. ``corpus``: of which they are a portion."""
        ready = []
        for key, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            w, a = item_words(text or "")
            if len(w):
                ready.append((key, w, a))
        if not ready:
            return None
        size = np.array([len(w) for _, w, _ in ready])
        item = np.repeat(np.arange(len(ready)), size)
        terms, term = np.unique(np.concatenate([w for _, w, _ in ready]), return_inverse=True)
        pair, tf = np.unique(term * len(ready) + item, return_counts=True)
        term, item = pair // len(ready), pair % len(ready)
        if corpus is None:
            corpus = Corpus(len(ready), int(size.sum()), int(size.max()), terms, np.bincount(term, minlength=len(terms)))
        df, mean = corpus.df[np.searchsorted(corpus.terms, terms)], corpus.words / corpus.items
        weight = np.log(1 + (corpus.items - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / mean))
        impact = weight / np.bincount(item, weight)[item]
        first = np.searchsorted(term, np.arange(len(terms) + 1))
        blocks, at = np.unique(term * _blocks(len(ready)) + item // BLOCK, return_index=True)
        top = np.maximum.reduceat(impact, at)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[terms >> _FILTER_SHIFT] = True
        return Index([k for k, _, _ in ready], [w for _, w, _ in ready], [a for _, _, a in ready], terms, seen, first, item, impact, pair, np.maximum.reduceat(impact, first[:-1]), blocks, top, np.repeat(top, np.diff(np.r_[at, len(pair)])), 2 * max(64, corpus.largest + 2 * n))

    def search(self, wh: np.ndarray, first: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """(row, first word, end word, item, score) of all passages and items at or above the
        threshold; the words of row r are first[r] to first[r + 1]."""
        pos = np.flatnonzero(self.seen[wh >> _FILTER_SHIFT])
        term = np.searchsorted(self.terms, wh[pos])
        known = (term < len(self.terms)) & (self.terms[np.minimum(term, len(self.terms) - 1)] == wh[pos])
        pos, term = pos[known], term[known]
        row = np.searchsorted(first, pos, "right") - 1
        step = self.passage // 2
        n = np.diff(first) // step + 1
        stripe = np.cumsum(n) - n  # number of the row's first passage
        nth = (pos - first[row]) // step
        # a word stands in the passage that begins with its stripe and in the one before
        late = nth > 0
        passage = np.r_[stripe[row] + nth, (stripe[row] + nth - 1)[late]]
        term, of_row = np.r_[term, term[late]], np.r_[row, row[late]]
        hit, at = np.unique(passage * len(self.terms) + term, return_index=True)
        passage, term, of_row = hit // len(self.terms), hit % len(self.terms), of_row[at]
        start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, np.int64)
        query = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(passage)]))
        out = []
        for q, item, score in zip(*self.retrieve(query, term, threshold - 1e-9), strict=True):
            r = int(of_row[start[q]])
            begin = int(first[r] + (passage[start[q]] - stripe[r]) * step)
            out.append((r, begin, min(begin + self.passage, int(first[r + 1])), int(item), float(score)))
        return out

    def retrieve(self, query: np.ndarray, term: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, item, score of all items that score ``floor`` or more, by block-max WAND.
        (query, term): the distinct terms of the queries, in order."""
        n, blocks = len(self.ids), _blocks(len(self.ids))
        most = np.bincount(query, self.list_max[term], int(query[-1]) + 1 if len(query) else 0)
        keep = np.flatnonzero(most[query] >= floor)
        query, term = query[keep], term[keep]
        at, found = self.first[term], []
        here = self.item[at]
        while len(query):
            turn = np.argsort(query * (n + 1) + here, kind="stable")  # lists by query and present item
            query, term, at, here = query[turn], term[turn], at[turn], here[turn]
            start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
            size = np.diff(np.r_[start, len(query)])
            most = self.list_max[term]
            total = np.cumsum(most)
            reaches = total - np.repeat(total[start] - most[start], size) >= floor
            pivot = np.minimum.reduceat(np.where(reaches, np.arange(len(query)), len(query)), start)
            alive = np.repeat(pivot < len(query), size)  # the other queries are done
            if not alive.any():
                break
            item = np.repeat(here[np.minimum(pivot, len(query) - 1)], size)[alive]
            query, term, at, here = query[alive], term[alive], at[alive], here[alive]
            start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
            of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(query)]))
            before = here <= item  # lists that may hold the pivot
            bound = np.where(before & (here // BLOCK == item // BLOCK), self.block_of[at], 0.0)
            behind = np.flatnonzero(before & (here // BLOCK < item // BLOCK))
            bound[behind] = _looked_up(self.block, self.block_max, term[behind] * blocks + item[behind] // BLOCK)
            may = np.add.reduceat(bound, start) >= floor
            score = np.where(before & (here == item) & may[of], self.impact[at], 0.0)
            behind = np.flatnonzero((here < item) & may[of])
            score[behind] = _looked_up(self.posting, self.impact, term[behind] * n + item[behind])
            good = np.flatnonzero((may & (np.add.reduceat(score, start) >= floor))[of])
            if len(good):
                good = good[np.lexsort((term[good], of[good]))]  # one order of addition, whatever else is indexed
                one = np.flatnonzero(np.r_[True, of[good][1:] != of[good][:-1]])
                found.append((query[good][one], item[good][one], np.add.reduceat(score[good], one)))
            after = np.minimum.reduceat(np.where(before, n, here), start)
            skip = np.minimum((item[start] // BLOCK + 1) * BLOCK, after)
            to = np.where(may, item[start] + 1, skip)[of]
            # most lists move on by one; the others are searched
            at, end = at + before, self.first[term + 1]
            here = np.where(at < end, self.item[np.minimum(at, len(self.item) - 1)], n)
            far = np.flatnonzero(before & (here < to))
            at[far] = np.searchsorted(self.posting, term[far] * n + np.minimum(to[far], n))
            here[far] = np.where(at[far] < end[far], self.item[np.minimum(at[far], len(self.item) - 1)], n)
            keep = np.flatnonzero(here < n)
            query, term, at, here = query[keep], term[keep], at[keep], here[keep]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, item, score = (np.concatenate(x) for x in zip(*found, strict=True))
        turn = np.lexsort((item, query))
        return query[turn], item[turn], score[turn]

    def overlap(self, item: int, passage: np.ndarray, n: int) -> tuple[float, float]:
        """Shares of the words of question and answer that stand in runs of n words which item
        and passage share. A part without words counts as the other does; a part of fewer than n
        words is covered, too, where it stands whole and near the other."""
        words, cut = self.words[item], self.answer[item]
        if len(words) < n:
            found = float((_aligned(words, passage, n) >= 0).any())
            return found, found
        runs = lambda w: t.shingles(w, np.array([0, len(w)]), n)[0]
        covered = np.zeros(len(words), bool)
        for k in np.flatnonzero(np.isin(runs(words), runs(passage))):
            covered[k : k + n] = True
        if cut in (0, len(words)):
            return covered.mean(), covered.mean()
        question, answer = covered[:cut].mean(), covered[cut:].mean()
        if cut < n and question < 1 and _stands_near(words[:cut], words[cut:], passage, n):
            question = 1.0
        if len(words) - cut < n and answer < 1 and _stands_near(words[cut:], words[:cut], passage, n):
            answer = 1.0
        return question, answer


def _aligned(part: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """For each word of the passage its place in ``part``, if it is in a run of n words, or of
    all words of a shorter part, that both share; else -1."""
    k, at = min(n, len(part)), np.full(len(passage), -1)
    if len(passage) < k:
        return at
    run, place = np.unique(t.shingles(part, np.array([0, len(part)]), k)[0], return_index=True)
    there = t.shingles(passage, np.array([0, len(passage)]), k)[0]
    near = np.minimum(np.searchsorted(run, there), len(run) - 1)
    for s in np.flatnonzero(run[near] == there):
        at[s : s + k] = place[near[s]] + np.arange(k)
    return at


def _stands_near(part: np.ndarray, other: np.ndarray, passage: np.ndarray, n: int) -> bool:
    """Whether a part of fewer than n words stands whole within 2 n words of a shared run of the
    other part, and not as words of that part itself."""
    place = _aligned(other, passage, n)
    for s in np.flatnonzero(_aligned(part, passage, n) == 0):
        e = s + len(part)
        if (place[s:e] >= 0).any():
            continue
        before, after = place[max(0, s - 2 * n) : s], place[e : e + 2 * n]
        before, after = before[before >= 0], after[after >= 0]
        between = len(before) and len(after) and before[-1] < after[0]  # a word that the copy has changed
        if (len(before) or len(after)) and not between:
            return True
    return False


def _blocks(items: int) -> int:
    return (items - 1) // BLOCK + 1


def _looked_up(keys: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values of keys in order, 0 for what is none."""
    place = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where(keys[place] == at, values[place], 0.0)


def _marker(indexes: list[Index], names: list[str], text_at: int, old_at: int | None, threshold: float, cover: float, n: int, out_col: str):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(LEAKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaks: list[list] = [[] for _ in range(batch.num_rows)] if old_at is None else batch.column(old_at).to_pylist()
            for i, _, data, off in t.column_blocks(batch.column(text_at)):
                start, end, first = t.words(data, off, t.SIGNS)
                wh = t.word_hashes(data, start, end)
                for index in indexes:
                    best: dict[tuple[int, int], tuple] = {}
                    for row, a, b, item, score in index.search(wh, first, threshold):
                        question, answer = index.overlap(item, wh[a:b], n)
                        if min(question, answer) >= cover and score > best.get((row, item), (0.0,))[0]:
                            best[row, item] = (score, float(question), float(answer))
                    for (row, item), (score, question, answer) in best.items():
                        leaks[i + row].append({"item_id": index.ids[item], "score": score, "question_overlap": question, "answer_overlap": answer})
            for own in leaks:
                own.sort(key=lambda x: (x["item_id"] is None, x["item_id"] or 0, *(-x[f.name] for f in LEAKS.elementType.fields[1:])))
            yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(batch.columns) if k != old_at], pa.array(leaks, kind)], [*names, out_col])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """portion, term for the distinct words of each item; words, their number, once an item."""
    for batch in batches:
        for portion, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = item_words(text or "")[0]
            if len(words):
                terms = np.unique(words).view(np.int64)
                once = pa.array([len(words), *[None] * (len(terms) - 1)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), portion, np.int64)), pa.array(terms), once], ["portion", "term", "words"])


def _corpora(items: DataFrame, portion: Column, portions: int) -> Iterator[Corpus]:
    """What each portion needs to know of all."""
    held = written(items.select(portion.cast("long").alias("portion"), "text").mapInArrow(_item_terms, "portion long, term long, words long"), "terms")
    total = held.agg(F.count("words"), F.sum("words"), F.max("words")).first()
    counted = written(held.groupBy("term").agg(F.count("*").alias("df"), F.collect_set("portion").alias("portions")), "frequencies")
    for k in range(portions):
        own = counted.where(F.array_contains("portions", F.lit(k).cast("long"))).select("term", "df").toArrow()
        terms = own.column("term").to_numpy().view(U)
        order = np.argsort(terms)
        yield Corpus(total[0], total[1] or 0, total[2] or 0, terms[order], own.column("df").to_numpy()[order])


def mark_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, cover: float = 0.6, n: int = 5, text_col: str = "text", out_col: str = "leaks") -> DataFrame:
    """``docs`` with leaks, an array of item_id, score, question_overlap, answer_overlap; a column
    of its name is replaced."""
    docs = docs.drop(out_col)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, LEAKS)])
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    portions = max(1, -(-int(total) // PORTION))
    portion = F.pmod(F.xxhash64("item_id", "text"), F.lit(portions))
    indexes = []
    for k, corpus in enumerate([None] if portions == 1 else _corpora(items, portion, portions)):
        part = items if portions == 1 else items.where(portion == k)
        index = Index.build([tuple(r) for r in part.collect()], n, corpus)
        indexes += [index] if index is not None else []
    out, old = docs, None
    for k in range(0, len(indexes), HELD):
        out = out.mapInArrow(_marker(indexes[k : k + HELD], names, names.index(text_col), old, threshold, cover, n, out_col), schema)
        old = len(names)
    return out if old is not None else docs.withColumn(out_col, F.array().cast(LEAKS))


def leak_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that leaked into it."""
    marked = mark_leaks(docs.select("doc_id", "text"), benchmark)
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.score", "leak.question_overlap", "leak.answer_overlap")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaked."""
    leaks = fresh(docs, "leaks")
    return mark_leaks(docs, benchmark, out_col=leaks).where(F.size(leaks) == 0).drop(leaks)
