"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled texts train a network of one hidden layer that
minimises the non-negative unbiased risk  prior * E_pos[l(+)] + max(0, E_unl[l(-)] - prior *
E_pos[l(-)]) with the logistic loss; where the second part falls below zero, its gradient is
turned round. The class prior is estimated from positives and unlabelled texts alone: a network
that tells the two apart is fitted on one half of them, and on the other half the prior is the
least ratio, over scores, of the shares of unlabelled texts and of positives above the score, as
regions without negatives hold as much of the unlabelled texts as the prior says.

Features are statistics of the whole text: shares of kinds of bytes, word lengths, repetition of
words, neighbours and lines, and length; never labels, language, source or id. The fit takes a
bounded sample chosen by a hash of id and text, about ``positives`` labelled and ``unlabelled``
other texts and never over twice as many, whose features alone reach the driver. Scoring reads
every text.

Defined results: a null text scores as an empty one; labels that are null or without document do
not count, repeated labels are averaged; without positives every score is 0.01 (0.5 if there are
no labels). An empty table gives an empty result. A null id is neither held out nor learned from. Rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textnum as t
from tessera.llm.langid import fold
from tessera.llm.ranking import unit_hash

#: Kinds of bytes: other sign, small letter, capital, digit, space, line end, full stop or comma,
#: mark of exclamation or question, byte beyond ASCII, bar.
KIND = np.zeros(256, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[[32, 9]], KIND[[10, 13]] = 1, 2, 3, 4, 5
KIND[[44, 46, 58, 59, 39, 45]], KIND[[33, 63]], KIND[128:], KIND[124] = 6, 7, 8, 9
KINDS = 10
FEATURES = KINDS + 10


def _runs(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: number of values, share of values that are repeats, share of the commonest value."""
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    start = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])]) if len(v) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(v)])
    most = np.zeros(len(n))
    np.maximum.at(most, r[start], size)
    kinds = np.bincount(r[start], minlength=len(n))
    some = np.maximum(n, 1)
    return n, (n - kinds) / some, most / some


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers for each text."""
    rows, size = len(off) - 1, np.diff(off)
    row = np.repeat(np.arange(rows), size)
    kinds = np.bincount(row * KINDS + KIND[data], minlength=rows * KINDS).reshape(rows, KINDS)
    start, end, first = t.words(data, off)
    wh = t.word_hashes(data, start, end)
    n, repeats, most = _runs(wh, first)
    word_row = np.repeat(np.arange(rows), n)
    same = np.zeros(len(wh), bool)
    same[1:] = (wh[1:] == wh[:-1]) & (word_row[1:] == word_row[:-1])
    length = (end - start).astype(float)
    some = np.maximum(n, 1)
    of = lambda x: np.bincount(word_row, x, rows) / some
    mean = of(length)
    signs = of((KIND[data[end - 1]] == 0).astype(float)) if len(start) else np.zeros(rows)
    breaks = np.flatnonzero(KIND[data] == 5)
    cuts = np.unique(np.r_[off, breaks + 1])
    cuts = cuts[cuts <= len(data)]
    line_end = np.minimum(np.r_[cuts[1:], len(data)], len(data))[: len(cuts)]
    full = line_end - cuts > 1
    lines, line_end = cuts[full], line_end[full]
    line_hash = t.word_hashes(data, lines, line_end) if len(lines) else np.zeros(0, np.uint64)
    n_lines, line_repeats, line_most = _runs(line_hash, np.searchsorted(lines, off))
    total = np.maximum(size, 1)[:, None]
    return np.column_stack([kinds / total, np.log1p(n), mean, np.sqrt(np.maximum(of(length**2) - mean**2, 0)), repeats / np.log(n + 3), most, of(same.astype(float)), signs, np.log1p(n / np.maximum(n_lines, 1)), line_repeats, line_most])


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))


def constant(p: float) -> Scorer:
    return Scorer(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), np.array(np.log(p / (1 - p))))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 600, decay: float = 1e-3, seed: int = 4) -> Scorer:
    """Full-batch Adam on the non-negative risk."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    xp, xu = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    params = [rng.normal(0, FEATURES**-0.5, (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(0.0)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for step in range(1, steps + 1):
        w1, b1, w2, b2 = params
        hp, hu = np.tanh(xp @ w1 + b1), np.tanh(xu @ w1 + b1)
        zp, zu = hp @ w2 + b2, hu @ w2 + b2
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, uu = prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)  # slopes of the negative part
        if negative >= 0:
            gp, gu = -prior * sigmoid(-zp) / len(zp) - up, uu
        else:
            gp, gu = up, -uu
        dp, du = gp[:, None] * w2 * (1 - hp**2), gu[:, None] * w2 * (1 - hu**2)
        grads = [xp.T @ dp + xu.T @ du + decay * w1, dp.sum(0) + du.sum(0), hp.T @ gp + hu.T @ gu + decay * w2, gp.sum() + gu.sum()]
        rate = 0.02 * (1 - step / (steps + 1))
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Scorer(mean, scale, *params)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.25) -> float:
    """Share of positives among the unlabelled, 0.01 to 0.99. Scores that fewer than ``least`` of
    the positives reach are left out, as few texts say little; under 20 texts give 0.5."""
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    scorer = fit(positive[::2], unlabelled[::2], 0.5, steps=200)
    p, u = np.sort(scorer.score(positive[1::2])), np.sort(scorer.score(unlabelled[1::2]))
    at = p[: max(1, int(len(p) * (1 - least)))]
    above = lambda x: (len(x) - np.searchsorted(x, at)) / len(x)
    return float(np.clip((above(u) / above(p)).min(), 0.01, 0.99))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in t.column_blocks(batch.column(2)):
            x = features(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["u", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000, seed: int = 21) -> Scorer:
    """The scorer fitted on the rows whose id is not held out."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    of = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    if not of.get(1):
        return constant(0.01 if of else 0.5)
    chosen = labels.where("label = 1").where(unit_hash(F.lit(seed), F.col("doc_id")) < min(1.0, positives / of[1])).select("doc_id")
    n = docs.count()
    rows = docs.where(F.coalesce(fold(F.col("doc_id"), 5) != 0, F.lit(False))).select("doc_id", "text").withColumn("u", unit_hash(F.lit(seed + 1), F.col("doc_id"), F.col("text")))
    trusted = rows.join(chosen, "doc_id").select("u", F.lit(1).alias("label"), "text")
    web = rows.where(F.col("u") < min(1.0, unlabelled / max(1, n))).select("u", F.lit(0).alias("label"), "text")
    x = []
    for part, most in ((trusted, positives), (web, unlabelled)):
        got = part.mapInArrow(_features, "u double, label int, x array<double>").orderBy("u", "x").limit(2 * most).collect()
        x.append(np.array([r["x"] for r in got]))
    if not (len(x[0]) and len(x[1])):
        return constant(0.5)
    return fit(*x, class_prior(*x))


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The columns of ``docs`` with the score; a column of its name is replaced."""
    from pyspark.sql import types as T

    docs = docs.drop(out_col)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scorer.score(features(data, off)) for _, _, data, off in t.column_blocks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


def quality_digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The columns of op8."""
    scorer = train(docs, labels)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    scored = score(docs.select("doc_id", held, "text"), scorer)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
