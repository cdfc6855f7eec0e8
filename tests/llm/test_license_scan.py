"""License scan against a reading of every place of every text."""

from __future__ import annotations

import random
import re

import pytest

from tessera.llm import license_scan as ls

DOCS = "doc_id long, text string, licenses string, labels string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w = words(text)
    places = sorted((i, label) for phrase, label in ls.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def every_place(text):
    """Labels and the best coverage by trying every relative position, without rare words."""
    w, labels, best = words(text), set(), 0.0
    for t in ls.TEMPLATES:
        x = words(t.text)
        for o in range(-len(x), len(w)):
            share = sum(any(0 <= o + q + s < len(w) and w[o + q + s] == x[q] for s in range(-ls.SLACK, ls.SLACK + 1)) for q in range(len(x))) / len(x)
            if share < ls.COVERAGE:
                continue
            keys = [words(k) for k in t.keys]
            at = [next(i for i in range(len(x)) if x[i : i + len(k)] == k) for k in keys]
            if all(any(w[i : i + len(k)] == k for i in range(max(0, o + p - ls.SLACK), o + p + ls.SLACK + 1)) for k, p in zip(keys, at, strict=True)):
                labels.add(t.label)
                best = max(best, share)
    b = base(text)
    return ",".join(sorted(labels | set(filter(None, b[4].split(","))))), max(best, ls.MENTION if b[1] else 0.0)


def scanned(spark, docs):
    df = spark.createDataFrame(docs, DOCS)
    return ls.license_digest(df).collect()


def check(spark, docs):
    want = {}
    for i, text, *_ in docs:
        labels, score = every_place(text)
        n, k, first, last, names = base(text)
        want[i] = (n, k, first, last, names, labels, score)
    rows = scanned(spark, docs)
    assert len(rows) == len(docs)
    for r in rows:
        got = tuple(r)[1:]
        assert got[:6] == want[r.doc_id][:6] and got[6] == pytest.approx(want[r.doc_id][6]), r.doc_id


def test_notices_mentions_and_noise(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join(rng.choice(["the", "license", "version", "of", "any", "use", "zebra", "é", "GNU", "by", "cc"]) for _ in range(n))
    docs = []
    for t in ls.TEMPLATES:
        x = t.text.split()
        edited = x[: len(x) // 2] + ["inserted"] + x[len(x) // 2 :]
        half = x[: max(1, len(x) // 2)]
        docs += [f"{noise(20)}. {t.text} {noise(10)}", " ".join(edited), " ".join(half), "x " * 9 + t.text.upper().replace(" ", "\n * ")]
    docs += [noise(200) for _ in range(20)]
    docs += ["Apache License apache\tLICENSE, Apache-License", "mit. License", "GNU General Public Licenses", "CC-BY, cc by cc by cc", "gnu general public license", "see the MIT License or the Apache License, Version 2.0"]
    check(spark, [(i, x, "clash", "clash") for i, x in enumerate(docs)])


def test_unusual_texts(spark):
    long = "lorem ipsum " * 60_000 + "Released under the MIT License. " + "the license of " * 2_000
    docs = [(1, None), (2, ""), (3, "  ...  "), (4, "é"), (4, "é"), (None, "Released under the MIT License."), (5, "mit\x00license")]
    rows = {r.doc_id: r for r in scanned(spark, [(*d, None, None) for d in [*docs, (6, long)]])}
    assert (rows[1].n_words, rows[1].n_base, rows[1].first_word, rows[1].labels, rows[1].score) == (0, 0, None, "", 0.0)
    assert rows[None].labels == "mit" and rows[None].score == 1.0
    assert rows[5].n_base == 1 and rows[4].n_words == 1
    assert (rows[6].first_word, rows[6].last_word, rows[6].labels) == (120_003, 120_003, "mit")
    assert scanned(spark, []) == []


def test_scan_keeps_columns_and_spans(spark):
    r = ls.scan(spark.createDataFrame([(7, "so. Licensed under CC BY-NC 4.0.", "old", "kept")], DOCS)).first()
    assert (r.doc_id, r.labels) == (7, "kept")
    assert [tuple(m) for m in r.licenses.matches] == [("cc-by-nc-4.0", 1, 7, 1.0)]
    assert (r.licenses.base_labels, r.licenses.labels) == ("cc-by", "cc-by,cc-by-nc-4.0")
