"""N-gram join, vectors, repeated strings: against brute force on small tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join, projection_dedup, suffix_dedup
from tessera.operators.graph import components


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)), key=lambda x: (x is None, x))
        root[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, n=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_texts(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(3))
    out = []
    for g in range(12):
        base = [word() for _ in range(rnd.randint(1, 60))]
        for _ in range(rnd.randint(1, 12)):
            w = list(base)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = word()
            out.append(" ".join(w))
        out.append(" ".join(base).upper() + "\n")
    return out + ["", "   \n", None, "one", "ONE", "one two three four", " ".join(word() for _ in range(30_000))]


def test_band_plan_reaches_recall():
    b, r = ngram_join.band_plan(0.8, 0.9999)
    assert b * r <= 128 and 1 - (1 - 0.8**r) ** b >= 0.9999


@pytest.mark.parametrize("block", [512, 4])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("keys", F.lit(1)).repartition(3)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = groups(sets, links)
    got = {r.doc_id: r for r in ngram_join.jaccard_classes(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in x for x in links) for i in sets}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_join_of_nulls_repeats_and_nothing(spark):
    t = "a b c d e f g h"
    docs = spark.createDataFrame([(None, t), (4, t), (4, t), (2, t), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_links, r.class_id) for r in ngram_join.jaccard_classes(docs).collect())
    assert got == [(False, 2, 3, 2), (False, 4, 3, 2), (False, 4, 3, 2), (False, 9, 0, 9), (True, 0, 3, 2)]
    assert ngram_join.jaccard_classes(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one(docs).collect()) == ["2", "9", "None"]


def test_one_row_of_each_class_is_kept(spark):
    t, u, v = ("".join(f"{c}{k} " for k in range(30)) for c in "abc")
    docs = spark.createDataFrame([(1, t), (1, t), (1, t + "x"), (2, t), (3, u), (3, v), (None, v + "x"), (None, v), (None, v), (7, None), (7, None)], "doc_id long, text string")
    got = [(r.doc_id, (r.text or "?")[0]) for r in ngram_join.keep_one(docs).collect()]
    assert sorted(got, key=str) == [(1, "a"), (3, "b"), (3, "c"), (7, "?"), (7, "?"), (None, "c")]
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [512, 8])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(projection_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, None):
        for _ in range(30):
            v = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((len(rows), (v * rng.uniform(0.5, 2) + 0.045 * np.linalg.norm(v) / 4 * rng.standard_normal(16)).tolist(), label))
    rows += [(900 + i, [1.0] * 16, 0) for i in range(40)] + [(950, [2.0] * 16, 0), (951, None, 0), (952, [0.0] * 16, 0), (953, [float("nan")] * 16, 0), (954, [None] * 16, 0), (955, [float("inf")] + [1.0] * 15, 0), (956, [1.0] * 8, 0), (957, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x"))
    usable = {i: (np.array(v, float), l) for i, v, l in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and l is not None}
    near = lambda x, y: len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98
    links = [(i, j) for i in usable for j in usable if i < j and usable[i][1] == usable[j][1] and near(usable[i][0], usable[j][0])]
    want = groups([r[0] for r in rows], links)
    got = {r.vec_id: r for r in projection_dedup.near_vectors(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == {r[0]: sum(r[0] in x for x in links) for r in rows}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert projection_dedup.near_vectors(df.limit(0)).count() == 0


def test_recall_just_above_the_threshold(spark):
    """1,500 pairs at 0.8 to 0.85: 100 words of which two, apart from each other, are changed."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(10**6)}"
    rows = []
    for i in range(1500):
        a = [word() for _ in range(100)]
        b = list(a)
        for at in (rnd.randrange(5, 45), rnd.randrange(55, 95)):
            b[at] = word()
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        x, y = shingles(rows[-2][1]), shingles(rows[-1][1])
        assert 0.8 <= len(x & y) / len(x | y) < 0.85
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (got.class_id == got.doc_id // 2 * 2).mean() >= 0.999 and got.n_links.max() == 1


@pytest.mark.parametrize("window", [128, 8])
def test_planted_pairs_are_found_with_long_codes(spark, monkeypatch, window):
    """12,000 vectors of two labels, 300 planted pairs from 0.98 to 0.99 and one dense cluster."""
    monkeypatch.setattr(projection_dedup, "WINDOW", window)
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((11_000, 32)))
    side = rng.standard_normal((300, 32))
    side = unit(side - (side * base[:300]).sum(1, keepdims=True) * base[:300])
    cos = rng.uniform(0.9801, 0.99, (300, 1))
    near = base[:300] * cos + side * np.sqrt(1 - cos**2)
    centre = unit(rng.standard_normal(32))
    cluster = unit(centre + 0.024 * rng.standard_normal((700, 32)))
    x = np.concatenate([base, near, cluster])
    label = np.arange(len(x)) % 2
    label[11_000:11_300] = label[:300]
    label[11_300:] = 1
    bits, passes = projection_dedup.pass_plan(6_500, 0.98, 0.99999)
    assert bits >= (7 if window == 128 else 10)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = projection_dedup.near_vectors(df.repartition(4)).toPandas().set_index("vec_id").n_links.reindex(range(len(x))).to_numpy()
    want = np.zeros(len(x), int)
    for k in (0, 1):
        at = np.flatnonzero(label == k)
        want[at] = ((x[at] @ x[at].T) >= 0.98).sum(1) - 1
    assert want[11_000:11_300].min() >= 1 and want[11_300:].sum() > 10_000 and (got <= want).all()
    assert got.sum() >= 0.9999 * want.sum()


def brute(rows, size):
    key = lambda d: (d is not None, d or 0)
    first = {}
    for d, x in rows:
        x = (x or "").encode()
        for i in range(len(x) - size + 1):
            v = (key(d), i)
            first[x[i : i + size]] = min(first.get(x[i : i + size], v), v)
    out = []
    for d, x in rows:
        x = (x or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - size + 1):
            if first[x[i : i + size]] < (key(d), i):
                gone[i : i + size] = b"\1" * size
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("hot", [2000, 10])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rnd = random.Random(3)
    some = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    base = some(400, "abcdé ")
    rows = [(None, base[:250]), (None, base[:250]), (1, None), (1, base), (1, base), (1, base[50:] + "x"), (2, ""), (3, "ab" * 300), (4, "ab" * 300), (5, base[100:260] * 2), (6, "x" * 99), (8, some(40_000, "pqrs") + base)]
    rows += [(10 + i, some(60, "xyz") + base[100:190] + some(60, "xyz")) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("place", F.lit(1)).repartition(4)
    got = sorted(repr(tuple(r)) for r in suffix_dedup.dedup_digest(df).collect())
    assert got == brute(rows, 100)
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_documents(df).where("doc_id in (3, 4)").collect()}
    assert kept[4] == b"" and len(kept[3]) < 600
    assert suffix_dedup.dedup_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2000, 3])
def test_rows_are_told_apart_by_id_and_whole_text(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    words = F.transform(F.sequence(F.lit(0), F.lit(21)), lambda k: F.hex(F.xxhash64("id", k)))
    texts = spark.range(150_000).select(F.substring(F.concat_ws(" ", words), 1, 154).alias("text"))
    pair = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("same")).where(F.size("same") > 1).first().same
    a, b = pair[:2]  # equal in the 32-bit hash
    passage = "".join(random.Random(8).choice("abcdefgh ") for _ in range(160))
    rows = [(1, a), (2, a), (2, b), (None, a), (None, b), (None, b)]
    rows += [(5, x + passage + y) for x, y in (("", ""), ("", "one"), ("", "another"), ("at ", ""), ("", ""))]
    rows += [(None, x + passage) for x in ("", "", "some ")] + [(k, passage + str(k) * 40) for k in range(10, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(repr(tuple(r)) for r in suffix_dedup.dedup_digest(df).collect()) == brute(rows, 100)


def test_interval_expansion_finds_classes():
    rnd = random.Random(1)
    for size in (2, 3, 7):
        for _ in range(20):
            strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(size, 25))) for _ in range(rnd.randint(1, 15))]
            windows = np.array([len(s) - size + 1 for s in strings])
            doc, place = np.array([rnd.randint(1, 5) for _ in strings]), np.array([rnd.randint(0, 50) for _ in strings])
            best = {}
            for k, s in enumerate(strings):
                for o in range(windows[k]):
                    v = (doc[k], place[k] + o)
                    best[s[o : o + size]] = min(best.get(s[o : o + size], v), v)
            for k, skip, n, fd, fp in zip(*suffix_dedup.earliest(strings, windows, doc, place, size), strict=True):
                for o in range(n):
                    assert best[strings[k][skip + o : skip + o + size]] == (fd, fp + o)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: c for n, c in groups(nodes, edges).items() if n in linked}


def test_hot_anchors_move_no_text_again(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    quoted = "".join(rng.choice(list("abcdefgh"), 150))
    rows = [(i, "".join(rng.choice(list("stuvwxyz"), 90)) + quoted + "".join(rng.choice(list("stuvwxyz"), 90))) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    df, plans, got = spark.read.parquet(str(tmp_path / "docs")), [], []
    for hot in (2, 2000):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        d = suffix_dedup.dedup_digest(df)
        plans.append(d._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        got.append(sorted(repr(tuple(r)) for r in d.collect()))
    assert plans[0] == plans[1]
    assert got[0] == got[1] == brute(rows, 100)
