"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Every text is cut, whole, into windows of WINDOW bytes; bytes are embedded, filters of widths 2, 3
and 4 run over them, each is pooled to its maximum in the window, and a softmax gives the window's
probabilities. A document's probabilities are the mean over its windows, weighted by bytes.

The network is fitted on the driver on a bounded sample: about ``per_language`` texts of each
language, chosen by a hash of the id, of each of which one run of SPAN characters from a place
chosen by hash; at most ``most_texts`` texts and languages. Prediction reads every byte.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every
text if nothing is labelled; a null id is neither held out nor learned from. Rows are scored one
by one, so repeated rows, ties and other columns do not matter. No shuffle of texts takes place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textnum as t
from tessera.llm.ranking import unit_hash
from tessera.llm.shared import fresh
from tessera.operators.tables import written

WINDOW, SPAN = 128, 512
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 8
UNDETERMINED = "und"


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """For each width: inputs of the filters, maxima, and where they are."""
        x = self.embed[windows]
        ins, tops, at = [], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            view = np.lib.stride_tricks.sliding_window_view(x, w, axis=1)  # n, positions, embed, w
            cols = view.reshape(len(x), x.shape[1] - w + 1, -1)
            out = cols.reshape(-1, cols.shape[2]) @ f
            out = out.reshape(len(x), -1, FILTERS)
            k = out.argmax(1)
            ins.append(cols)
            at.append(k)
            tops.append(np.take_along_axis(out, k[:, None], 1)[:, 0] + b)
        return ins, tops, at

    def maxima(self, windows: np.ndarray) -> np.ndarray:
        """Pooled filters of the windows, by one product per width."""
        x = self.embed[windows]
        tops = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            n, m = x.shape[0], x.shape[1] - w + 1
            parts = f.reshape(EMBED, w, FILTERS)
            out = np.zeros((n, m, FILTERS), np.float32)
            for i in range(w):
                out += (x[:, i : i + m].reshape(-1, EMBED) @ parts[:, i]).reshape(n, m, FILTERS)
            tops.append(out.max(1) + b)
        return np.maximum(np.concatenate(tops, 1), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.maxima(windows) @ self.dense + self.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def windows_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts that have bytes, padded with 0; their row; their true lengths."""
    size = np.diff(off)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = off[:-1][row] + nth * WINDOW
    length = np.minimum(WINDOW, off[1:][row] - start)
    at = start[:, None] + np.arange(WINDOW)
    out = np.where(np.arange(WINDOW) < length[:, None], data[np.minimum(at, max(0, len(data) - 1))], 0) if len(row) else np.zeros((0, WINDOW), np.uint8)
    return out.astype(np.uint8), row, length


def fit(windows: np.ndarray, target: np.ndarray, languages: list[str], steps: int = 700, batch: int = 64, seed: int = 1) -> Network:
    """Cross-entropy by Adam, languages equally likely in a batch; gradients by hand."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Network(languages, rng.normal(0, 0.5, (256, EMBED)).astype(f32), [rng.normal(0, (EMBED * w) ** -0.5, (EMBED * w, FILTERS)).astype(f32) for w in WIDTHS], [np.zeros(FILTERS, f32) for _ in WIDTHS], rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(f32), np.zeros(len(languages), f32))
    params = [net.embed, *net.filters, *net.bias, net.dense, net.offset]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    of = [np.flatnonzero(target == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(o, max(1, batch // len(languages))) for o in of])
        x, y = windows[pick], target[pick]
        ins, tops, at = net.pooled(x)
        raw = np.concatenate(tops, 1)
        act = np.maximum(raw, 0)
        z = act @ net.dense + net.offset
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ net.dense.T) * (raw > 0)
        g_embed, g_filters, g_bias = np.zeros_like(net.embed), [], []
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            cols = np.take_along_axis(ins[i], at[i][:, :, None], 1)  # n, filters, embed * w
            g_filters.append(np.einsum("nfe,nf->ef", cols, g))
            g_bias.append(g.sum(0))
            into = (g[:, :, None] * net.filters[i].T[None]).reshape(len(y), FILTERS, EMBED, w)
            for j in range(w):
                np.add.at(g_embed, x[np.arange(len(y))[:, None], at[i] + j], into[:, :, :, j])
        grads = [g_embed, *g_filters, *g_bias, act.T @ d, d.sum(0)]
        rate = 0.01 * (1 - step / (steps + 1))
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def fold(id_col: Column, folds: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def train(docs: DataFrame, per_language: int = 500, most_texts: int = 100_000, seed: int = 9) -> Network | None:
    """The network fitted on the rows of ``docs`` (doc_id, text, lang) whose id is not held out: about
    ``per_language`` of each language, fewer where they would be over ``most_texts`` in all, and
    never over twice as many. Languages are ``most_texts`` at most, the most frequent, which no true list of
    languages comes near."""
    rows = docs.where((fold(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = written(rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_texts), "languages")
    n_known = known.count()
    if not n_known:
        return None
    per_language = max(1, min(per_language, most_texts // n_known))
    rows = rows.join(F.broadcast(known), "lang").withColumn("rate", F.least(F.lit(1.0), per_language / F.col("n")))  # at most most_texts rows
    length = F.length("text")
    start = F.floor(unit_hash(F.lit(seed + 1), F.col("doc_id")) * F.greatest(length - SPAN, F.lit(0))).cast("int") + 1
    # the first text of each language by hash is always there
    u = unit_hash(F.lit(seed), F.col("doc_id"), F.col("text"))
    chosen = rows.withColumn("u", u).where(F.col("u") < F.col("rate")).select("u", "lang", F.substring("text", start, F.lit(SPAN)).alias("span"))
    firsts = rows.groupBy("lang").agg(F.min_by(F.struct(u.alias("u"), F.substring("text", start, F.lit(SPAN)).alias("span")), F.struct(u, "text")).alias("r")).select("r.u", "lang", "r.span")
    sample = chosen.orderBy("u", "lang", "span").limit(2 * per_language * n_known).collect()
    seen = {r["lang"] for r in sample}
    sample += [r for r in firsts.collect() if r["lang"] not in seen] if len(seen) < n_known else []
    got = sorted((r["lang"], r["u"], r["span"]) for r in sample)
    languages = sorted({x[0] for x in got})
    if not languages:
        return None
    texts = [x[2].encode() for x in got]
    off = np.r_[0, np.cumsum([len(x) for x in texts])]
    windows, row, length = windows_of(np.frombuffer(b"".join(texts), np.uint8), off)
    target = np.array([languages.index(x[0]) for x in got])[row]
    keep = (length >= WINDOW // 4) | ~np.isin(target, target[length >= WINDOW // 4])
    return fit(windows[keep], target[keep], languages)


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The columns of ``docs`` with the language and its probability; columns of these names are
    replaced."""
    from pyspark.sql import types as T

    docs = docs.drop(lang_out, score_out)
    names = docs.columns
    plain = docs.withColumn(fresh(docs, "letters"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.full(batch.num_rows, UNDETERMINED, object)
            score = np.zeros(batch.num_rows)
            letters = batch.column(len(names)).to_numpy(zero_copy_only=False)
            for i, j, data, off in t.column_blocks(batch.column(at)):
                if net is None or not len(data):
                    continue
                windows, row, length = windows_of(data, off)
                p = np.concatenate([net.probabilities(windows[c : c + 512]) for c in range(0, len(windows), 512)])
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                mean = np.add.reduceat(p * length[:, None], first) / np.add.reduceat(length, first)[:, None]
                has = row[first]
                ok = letters[i:j][has]
                lang[i + has[ok]] = np.array(net.languages, object)[mean[ok].argmax(1)]
                score[i + has[ok]] = mean[ok].max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], [*names, lang_out, score_out])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    return plain.mapInArrow(run, schema)


def language_digest(docs: DataFrame) -> DataFrame:
    """The columns of op9."""
    net = train(docs)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held, "text"), net).select("doc_id", "held_out", "lang_pred", "score")
