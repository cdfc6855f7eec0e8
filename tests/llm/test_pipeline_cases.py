"""Sharding against plain Python; pipeline stages on unusual tables."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def interleaved(rows, shards, seed=17):
    """(doc_id, crc32 of the text) -> shards and slots, by sorting."""
    keyed = []
    for i, text, source in rows:
        crc = zlib.crc32((text or "").encode())
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        for v in (i, crc):
            h = h if v is None else xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        keyed.append(("n" if source is None else "s" + source, h, i, crc))
    ranked = []
    for s in {k[0] for k in keyed}:
        own = sorted((k for k in keyed if k[0] == s), key=lambda k: k[1])
        ranked += [((2.0 * r - 1) / (2.0 * len(own)), s, r, *k[2:]) for r, k in enumerate(own, 1)]
    ranked.sort(key=lambda x: x[:3])
    out, m = {}, len(ranked)
    for g, (*_, i, crc) in enumerate(ranked):
        shard = g * shards // m
        out.setdefault((i, crc), []).append((shard, g - -(-shard * m // shards)))
    return out


def test_shards_equal_plain_python(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, i, i]), rnd.choice([None, "", "a", f"text {i}"]), rnd.choice([None, "p", "p", "q", "rr"])) for i in range(700)]
    rows += [(9, "same", "p")] * 3
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS).repartition(5)
    got = {}
    for r in sharding.shard_digest(df, 24).collect():
        assert r["size"] == len((next(t or "" for i, t, _ in rows if i == r.doc_id and zlib.crc32((t or "").encode()) == r.text_crc32)).encode()) + 8
        got.setdefault((r.doc_id, r.text_crc32), []).append((r.shard, r.slot))
    want = interleaved(rows, 24)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_unusual_tables(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rnd = random.Random(3)
    some = lambda n: " ".join(rnd.choice(["the", "and", "tion", "ing", "ed"]) + rnd.choice("abcdef") * rnd.randint(1, 3) for _ in range(n))
    texts = [some(60) for _ in range(30)]
    rows = [(i, x, "en", "s", len(x)) for i, x in enumerate(texts)] + [(None, texts[0], None, None, None), (None, None, None, None, None), (40, "", "en", "s", 0), (41, some(150_000), "en", "s", 1), (42, "x" * 1_000_000, "en", "s", 1), (1, texts[1], "en", "s", len(texts[1])), (1, texts[1], "en", "s", len(texts[1]))]
    spark.createDataFrame([(1, "What is this? A thing of some kind here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    more = ["score", "lang_pred", "leaks", "class_id", "copies", "_key", "unit"]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in more})
    out = stage(spark, df, str(tmp_path))
    kept = out.collect()
    assert out.columns[: 5 + len(more)] == df.columns and all(r[c] == c for r in kept for c in more)
    of = Counter((r.doc_id, r.text) for r in kept)
    assert set(of) <= {(r[0], r[1]) for r in rows} and of[41, rows[33][1]] >= 1
    assert name != "shards" or len(kept) == len(rows)
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_mix_of_long_and_empty_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, "w " * 200_000, "en", "s", 1), (2, None, "en", "t", 0), (None, "", None, None, 0)], DOCS)
    got = {r.doc_id: (r["size"], r.taken) for r in mixing.mix_digest(df, none).collect()}
    assert got[1][0] == 200_000 and got[1][1] in (200_000, 400_000) and got[2] == got[None] == (0, 0)
