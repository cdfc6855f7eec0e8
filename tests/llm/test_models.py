"""The trained models against plain loops and finite differences."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tessera.llm import langid, quality


def test_network_equals_plain_loops():
    rng = np.random.default_rng(8)
    texts = [b"short", "Straße und Fluß, ".encode() * 30, bytes(rng.integers(32, 127, 300, dtype=np.uint8))]
    off = np.r_[0, np.cumsum([len(x) for x in texts])]
    windows, row, length = langid.windows_of(np.frombuffer(b"".join(texts), np.uint8), off)
    want = [(r, x[i : i + langid.WINDOW]) for r, x in enumerate(texts) for i in range(0, len(x), langid.WINDOW)]
    assert [(r, bytes(w[:n])) for r, w, n in zip(row, windows, length, strict=True)] == want
    net = langid.fit(windows, np.arange(len(windows)) % 3, ["a", "b", "c"], steps=3, batch=6)
    got = net.probabilities(windows)
    for w, p in zip(windows, got, strict=True):
        pooled = []
        for width, filters, bias in zip(langid.WIDTHS, net.filters, net.bias, strict=True):
            parts = filters.reshape(langid.EMBED, width, langid.FILTERS)
            for f in range(langid.FILTERS):
                sums = [sum(float(net.embed[w[i + j], e]) * float(parts[e, j, f]) for j in range(width) for e in range(langid.EMBED)) for i in range(langid.WINDOW - width + 1)]
                pooled.append(max(0.0, max(sums) + float(bias[f])))
        z = [sum(x * float(d) for x, d in zip(pooled, net.dense[:, k], strict=True)) + float(net.offset[k]) for k in range(3)]
        e = [math.exp(x - max(z)) for x in z]
        assert p == pytest.approx([x / sum(e) for x in e], abs=1e-4)


@pytest.mark.parametrize("prior, shift", [(0.3, 0.0), (0.95, 3.0)])
def test_first_step_follows_the_slope_of_the_risk(prior, shift):
    """Adam's first step goes against the sign of each slope, which finite differences give; in
    the second case the negative part is below 0 and is raised instead."""
    rng = np.random.default_rng(1)
    positive, unlabelled = rng.normal(shift, 1, (40, quality.FEATURES)), rng.normal(-shift, 1, (60, quality.FEATURES))
    hidden, decay = 5, 1e-3
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    xp, xu = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    draw = np.random.default_rng(4)
    start = [draw.normal(0, quality.FEATURES**-0.5, (quality.FEATURES, hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, hidden), np.array(0.0)]

    def parts(params):
        w1, b1, w2, b2 = params
        zp, zu = (np.tanh(x @ w1 + b1) @ w2 + b2 for x in (xp, xu))
        soft = lambda z: np.log1p(np.exp(z)).mean()
        return prior * soft(-zp), soft(zu) - prior * soft(zp), decay / 2 * ((w1**2).sum() + (w2**2).sum())

    def risk(params):
        plus, minus, weight = parts(params)
        return (plus + minus if parts(start)[1] >= 0 else -minus) + weight

    after = quality.fit(positive, unlabelled, prior, hidden, steps=1, decay=decay)
    checked = 0
    for i, end in enumerate((after.w1, after.b1, after.w2, after.b2)):
        moved = np.asarray(end - start[i])
        for at in np.ndindex(moved.shape):
            slope = []
            for h in (1e-5, -1e-5):
                other = [p.copy() for p in start]
                other[i][at] += h
                slope.append(risk(other))
            g = (slope[0] - slope[1]) / 2e-5
            if abs(g) > 1e-6:
                checked += 1
                assert np.sign(moved[at]) == -np.sign(g) and abs(moved[at]) == pytest.approx(0.01, rel=0.05)
    assert checked > 50


def test_scores_equal_plain_sums():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 2, (7, quality.FEATURES))
    s = quality.fit(x[:4], x[3:], 0.5, hidden=3, steps=20)
    for row, got in zip(x, s.score(x), strict=True):
        own = [max(-6.0, min(6.0, (a - b) / c)) for a, b, c in zip(row, s.mean, s.scale, strict=True)]
        h = [math.tanh(sum(a * w for a, w in zip(own, s.w1[:, k], strict=True)) + s.b1[k]) for k in range(3)]
        assert got == pytest.approx(1 / (1 + math.exp(-(sum(a * b for a, b in zip(h, s.w2, strict=True)) + float(s.b2)))), rel=1e-9)
