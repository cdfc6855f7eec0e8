"""Collocations against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import collocations

DOCS = "doc_id long, text string, lang string, words string, n string, id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, top, percent):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    out = []
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inner = Counter()
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inner[lang, w[i : i + m]] = max(a, inner[lang, w[i : i + m]])
    for (lang, w), a in candidates.items():
        if 100 * inner[lang, w] >= percent * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    rows, rank = set(), Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.add((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return rows


def check(spark, docs, least=30, top=2000, percent=80):
    got = collocations.collocations(spark.createDataFrame(docs, DOCS), least, top, percent).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert len(set(got)) == len(got)
    assert {tuple(r) for r in got} == plain(docs, least, top, percent)
    return got


def texts(n, seed, words=40):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "of", "é", "Ça", "10%", "a-b", " x", *(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(8))])
    return ["".join(word() + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!"]) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("least, top, percent", [(3, 2000, 80), (5, 7, 50), (30, 2000, 80)])
def test_equals_a_plain_count(spark, least, top, percent):
    docs = [(i, x, ["en", "de", None, "und", ""][i % 5], None, None, None) for i, x in enumerate(texts(400, least))]
    assert check(spark, docs, least, top, percent)


def test_ranges_do_not_matter(spark, monkeypatch):
    docs = [(i, x, "en", None, None, None) for i, x in enumerate(texts(300, 7))]
    want = plain(docs, 4, 2000, 80)
    monkeypatch.setattr(collocations, "RANGE", 50)  # many borders within runs
    monkeypatch.setattr(collocations, "BLOCK", 500)
    got = collocations.collocations(spark.createDataFrame(docs, DOCS), 4).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert {tuple(r) for r in got} == want


def test_nulls_repeats_long_and_empty_texts(spark):
    docs = [(None, None, None), (1, "", "en"), (1, "a b c d e. " * 40, "en"), (1, "a b c d e. " * 40, "en"), (2, "x x x x x " * 20_000, "fr"), (3, "p q\nP Q " * 15, None), (3, "p q\nP Q " * 15, "und"), (4, ".,;:!?" * 50, "xx")]
    check(spark, [(*d, "clash", "clash", "clash") for d in docs])
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "no phrase here", "en", None, None, None)], DOCS)).count() == 0


def test_radix_order_and_packing():
    rng = np.random.default_rng(3)
    for high in (5, 70_000, 1 << 32):
        columns = [rng.integers(0, high, 3000).astype(np.uint32) for _ in range(3)]
        assert (collocations.radix_order(columns) == np.lexsort(columns[::-1])).all()
        assert (collocations.unpacked(collocations.packed(columns), 3) == columns).all()
    assert len(collocations.radix_order([np.zeros(0, np.uint32)])) == 0
