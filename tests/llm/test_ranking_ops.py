"""Sharding, mixing and pseudonyms: laws, oracles by hand, edges."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, pii, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n=120):
    out = [(i, f"w{i} " * (i % 9 + 1), "en", "a" if i % 3 else f"s{i % 4}", 5) for i in range(n)]
    return out + [(None, None, None, None, None), (7, "w7 " * 8, "en", "a", 5), (500, "", "en", "", 0), (501, "x " * 20_000, "de", None, 1)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def test_shards_follow_the_rows_law(docs):
    out = sharding.shard_digest(docs, 5).toPandas()
    n = out.groupby("shard").size()
    assert len(out) == 124 and n.max() - n.min() <= 1 and len(n) == 5
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert out.grown_shard.isna().all() and (out["size"] >= 8).all()
    null = out[out.doc_id.isna()].iloc[0]
    assert null["size"] == 8 and null.text_crc32 == 0
    one = out[out.doc_id == 3].iloc[0]
    assert one.text_crc32 == zlib.crc32(("w3 " * 4).encode()) and one["size"] == 12 + 8


def test_every_shard_has_the_mixture(docs):
    out = sharding.shard_documents(docs, 4).toPandas()
    share = Counter(out.source.fillna("?"))
    for _, g in out.groupby("shard"):
        for s, n in Counter(g.source.fillna("?")).items():
            assert abs(n - share[s] / 4) <= 1.5


def test_shards_keep_rows_and_clashing_columns(docs):
    wide = docs.withColumn("shard", F.lit("mine")).withColumn("_key", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    out = sharding.shard_documents(wide, 3)
    assert out.columns == [*[c for c in wide.columns if c != "shard"], "shard", "slot"]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in docs.collect())
    assert sharding.shard_digest(docs.limit(0)).count() == 0


def targets(sizes, cycle=(5, 2, 1)):
    """Shares cut at twice the size, the excess shared out until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: Fraction(cycle[i % 3]) for i, s in enumerate(order)}
    total, capped = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped.update({s: Fraction(2 * sizes[s]) for s in over})


def test_mix_hits_its_targets(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix_digest(docs, labels).toPandas()
    text = {i: t for i, t, *_ in rows()}
    source = {i: s for i, _, _, s, _ in rows()}
    sizes, taken, want = defaultdict(int), defaultdict(int), {}
    for r in out.itertuples():
        i = None if r.doc_id != r.doc_id else int(r.doc_id)
        assert r.size == len((text[i] or "").split()) and r.taken <= 2 * r.size
        sizes[source[i]] += r.size
        taken[source[i]] += r.taken
        want[source[i]] = r.target
    for s, t in targets(sizes).items():
        assert want[s] == pytest.approx(float(t))
        if s is not None:  # one document of 20,000 words, taken whole
            assert abs(taken[s] - float(t)) <= 9
    again = mixing.mix_digest(docs.repartition(3), labels)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.mix_digest(docs, labels).collect()))


def test_complete_epochs_come_first(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", s, 1) for i in range(40) for s in ("p", "q", "r")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, mixing.quality_weights(none), keep=["source"]).toPandas()
    assert set(out[out.source == "p"].copies) == {2}
    mixed = mixing.mixed_documents(docs.withColumn("copies", F.lit("x")), none)
    assert mixed.columns == [*docs.columns, "copies"] and mixed.count() == out.copies.sum()
    assert mixing.mix_digest(docs.limit(0), none).count() == 0


def test_better_documents_are_taken_more_often(spark):
    docs = spark.createDataFrame([(i, "a b", "en", s, 1) for s, k in (("b", 1000), ("a", 2000), ("a", 3000)) for i in range(k, k + 1000)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(1000, 2000)], "doc_id long, quality int, toxic int")
    out = mixing.mix_digest(docs, labels).where("doc_id < 2000 and taken > size").toPandas()
    assert 200 < len(out) < 400 and (out.doc_id % 2 == 1).mean() > 0.6


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_keep_formats_and_link(spark):
    valid = ["4111 1111 1111 1111", "1990-02-28", "31/12/1999", "123-45-6789", "GB82 WEST 1234 5698 7654 32", "+1 (415) 555-2671", "192.168.0.1", "jo.do@ex.org"]
    invalid = ["4111 1111 1111 1112", "2023-02-30", "666-45-6789", "GB83 WEST 1234 5698 7654 32", "300.1.1.1", "version 1.2.3", "page 1234567"]
    d = spark.createDataFrame([(i, f"é {v}, again {v}.") for i, v in enumerate(valid + invalid)] + [(90, None), (91, ""), (92, "plain " * 50_000)], "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("n_found", F.lit("x"))
    out = {r.doc_id: r for r in pii.pseudonymise(d, "k").collect()}
    for i, v in enumerate(valid):
        assert v not in out[i].text and out[i].n_found == 2
        new = out[i].text.removeprefix("é ").split(", again ")
        assert new[0] + "." == new[1]
        if v.count(".") != 3:  # octets of an address vary in length
            assert [c.isdigit() for c in new[0]] == [c.isdigit() for c in v]
    assert luhn(out[0].text[2:21].replace(" ", ""))
    for i, v in enumerate(invalid, len(valid)):
        assert out[i].text == f"é {v}, again {v}." and out[i].n_found == 0
    assert out[90].text is None and out[90].n_found == 0 and out[91].text == "" and out[92].n_found == 0 and out[0].found == 1
    assert {r.doc_id: r.text for r in pii.pseudonymise(d, "other").collect()}[0] != out[0].text


def test_valid_values_beside_other_figures_are_found(spark):
    card, iban, other = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332", "5500000000000004"
    flat = card.replace(" ", "")
    texts = [(f"{card} 123", 1), (f"{flat} 12", 1), (f"{iban} EUR", 1), (f"{flat},{other}", 2), ("2024-01-02,2024-01-03", 2), ("at 2024-01-02T10:00:00Z.", 1), (f"order 2024 {card}", 1), (f"{card} 123 456 7890", 2), ("host 192.168.0.1:8080", 1), (f"{flat}:123", 1), ("4111 1111 1111 1112 123", 0), (f"{iban[:-1]}3 EUR", 0), ("2024-01-02Two", 0), (f"{card}, {iban} and {card}", 3)]
    out = {r.id: r for r in pii.pseudonymise(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(texts)], "id long, text string"), "k").collect()}
    assert [out[i].n_found for i in range(len(texts))] == [n for _, n in texts]
    for i, (x, n) in enumerate(texts):
        assert (out[i].text == x) == (n == 0) and all(v not in out[i].text for v in (card, flat, other, "ES91 2100 0418 4502 0005 1332", "2024-01-0", "192.168.0.1") if n)
    assert out[0].text.endswith(" 123") and out[2].text.endswith(" EUR") and out[5].text.endswith("T10:00:00Z.") and out[8].text.endswith(":8080")


def test_permutations_are_undone_and_one_to_one(spark):
    s = spark.createDataFrame([(t,) for t in ("", "7", "abC-19", "9" * 40)], "s string")
    back = s.select("s", pii.permute_string(pii.permute_string(F.col("s"), "k", "t"), "k", "t", back=True).alias("b")).collect()
    assert all(r.s == r.b for r in back)
    ids = spark.range(17 * 31).select("id", pii.permute_index(F.col("id"), 17, 31, "k", "t").alias("j"))
    assert sorted(r.j for r in ids.collect()) == list(range(17 * 31))
    assert ids.select(pii.permute_index(F.col("j"), 17, 31, "k", "t", back=True).alias("b"), "id").where("b <> id").count() == 0
    assert pii.DAYS[0] * pii.DAYS[1] == 73_049
