"""Pages, leaks, language, quality, pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontamination, html_text, langid, quality
from tessera.llm import textnum as t

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_article_without_the_rest(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a>Menu</a></nav>
    <div class="ad">Buy</div><div id="cookie-notice">Cookies</div><main><div class="sidebar">side</div><article><header><h1>Head &amp; line</h1></header>
    <p>One  <b>bold</b>&nbsp;word<p>Two<script>var x="</p>";</script> &lt;p&gt; &eacute;<br>Three<!-- <p>no</p> --><ul><li>a<li>b</ul>
    <form><input name=q>Search</form><div class="comments"><p>Reader</p></div></article><p>outside</p></main><footer>&copy;</footer>"""
    rows = [(1, "http://a.b/c", page), (2, "u", None), (3, None, ""), (None, "u", "<main>x</main>"), (1, "http://a.b/c", page), (4, "u", "<article>" + "<p>long " * 30_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    out = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert out[1].text == "Head & line\nOne bold word\nTwo <p> é\nThree\na\nb"
    assert out[1].n_chars == len(out[1].text)
    assert out[2].text == "" and out[3].n_chars == 0 and out[None].text == "x" and out[4].text.count("\n") == 29_999
    assert html_text.main_text(df).count() == 6 and html_text.main_text(df.limit(0)).count() == 0


def test_slugs_and_figures_inside_an_article_stay():
    kept = ['<section id="related-work">a</section>', '<h2 id="search-results">b</h2>', '<h2 id="search">c</h2>', '<div id="form-factor">d</div>', '<section id="share-of-market">e</section>', '<p id="comment-on-method">f</p>', '<p class="ad-hoc">g</p>', "<p>h <math><mi>x</mi></math></p>", "<fieldset><label>i</label></fieldset>", "<figure><svg><text>j</text><text>k</text></svg></figure>", "<dialog open>l</dialog>", '<section id="notice">m</section>']
    gone = ['<div class="related-posts">no</div>', '<div id="comments">no</div>', '<ul class="x share_buttons">no</ul>', '<div class="ad">no</div>', '<div id="ad-slot-3">no</div>', "<form><label>no</label></form>", "<dialog>no</dialog>", "<math><annotation>no</annotation></math>"]
    for top in ('<article class="post tag-search">', "<main>"):
        text = " ".join(b for _, b in html_text.blocks(top + "".join(x + y for x, y in zip(kept, gone + gone, strict=False))))
        assert text == "a b c d e f g h x i j k l m"


def test_container_is_chosen_by_its_text(spark):
    story, teaser = "the long story " * 20, '<article class="card">teaser</article>'
    article = f"<article><p>{story}</p></article>"
    rows = [(1, f"<main><p>{story}</p>{teaser}</main>"), (2, f"<main><p>{story}</p></main>{teaser}"), (3, f"<div><p>{story}</p>{teaser}</div>"), (4, f"<main>{article}<p>more</p></main><p>x</p>"), (5, f"{article}<main>load</main>"), (6, f"<p>x</p>{article}")]
    rows += [(7, f"<main><p>{story}</p>{teaser * 60}</main>"), (8, "<main></main><p>only</p>")]
    df = spark.createDataFrame([(i, f"http://h{i}.com/", x) for i, x in rows], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    story = story.strip()
    assert len(out) == 8 and out[1] == out[3] == f"{story}\nteaser" and out[2] == out[4] == out[5] == out[6] == story
    assert out[7].startswith(f"{story}\nteaser") and out[8] == "only"


@pytest.mark.parametrize("hot", [2000, 10])
def test_host_suffix_array_removes_shared_runs(spark, monkeypatch, hot):
    monkeypatch.setattr(html_text, "HOT", hot)
    shared = " ".join(f"s{k}" for k in range(14))
    page = lambda i: f"<div>u{i} v{i} {shared} w{i}</div><p>Own {' '.join(f'o{i}_{k}' for k in range(20))}</p>"
    rows = [(i, f"http://h.com/{i}", page(i)) for i in range(40)] + [(90, "http://g.com/", page(1)), (91, "http://h.com/5", "<p>short"), (5, "http://h.com/5", page(5))]
    out = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(40):
        assert out[i] == f"u{i} v{i} w{i}\nOwn " + " ".join(f"o{i}_{k}" for k in range(20))
    assert shared in out[90] and out[91] == "short"


def test_marked_pages_are_evidence_on_their_host(spark):
    line, article = " ".join(f"s{k}" for k in range(14)), " ".join(f"a{k}" for k in range(40))
    rows = [(1, "http://h.com/1", f"<div>{line}</div><article>{article}</article>"), (2, "http://h.com/2", f"<div>{line}</div><p>own text</p><p>{article}</p>"), (3, "http://g.com/3", f"<div>{line}</div><p>own</p>")]
    out = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {1: article, 2: f"own text\n{article}", 3: f"{line}\nown"}


def test_leaks_are_found_and_clean_texts_left(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, f"What is {text(14)}? {text(8)}.") for i in range(40)] + [(None, text(20)), (77, "too short"), (78, None), (79, f"{text(20)}")]
    docs = [(0, text(900)), (1, text(300) + " " + items[3][1].upper() + " " + text(500)), (2, items[5][1].split("?")[0] + " " + text(40)), (3, None), (4, ""), (5, text(62) + " " + items[43][1]), (6, items[40][1]), (6, items[40][1]), (7, text(20_000) + items[9][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("leaks", F.lit(1)).withColumn("score", F.lit("s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontamination.leak_digest(df, bench).collect() if r.item_id is not None)
    assert got == [(1, 3), (5, 79), (7, 9)]
    assert decontamination.leak_digest(df, bench).where("doc_id = 6 and item_id is null").count() == 2
    kept = decontamination.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    assert decontamination.clean(df, bench.limit(0)).count() == 9 and decontamination.clean(df.limit(0), bench).count() == 0


def test_short_answers_and_unmarked_items_leak(spark):
    long = " ".join(f"u{k}" for k in range(20))
    items = [(1, "What is the capital city of the country France? Paris"), (2, "Who? The first person to walk on the far moon"), (3, f"{long}. Last sentence here."), (4, "zeta eta theta"), (5, "Is Rome or Oslo the larger city by population? Oslo"), (6, "Name the first king? Charles"), (7, "How many legs has a common house spider? Answer: eight")]
    docs = [(1, "Question: What is the capital city of the country France? Answer: Paris."), (2, "Who was it? The first person to walk on the far moon"), (3, f"x y {long} z"), (4, "a zeta, eta theta b"), (5, "Is Rome or Oslo the larger city by population? Ask them."), (6, "name the first king - answer: Charles"), (7, "How many legs has a common house spider? (a) six (b) eight")]
    docs += [(11, "What is the capital city of the country France? It is not said." + " w" * 20 + " Paris"), (13, " ".join(long.split()[:8])), (14, "zeta eta b theta"), (15, "Is Rome or great Oslo the larger city by population?")]
    pad = " ".join(f"p{k}" for k in range(90))
    df = spark.createDataFrame([(i, f"{pad} {x} {pad}") for i, x in docs], "doc_id long, text string")
    got = decontamination.leak_digest(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 1), (2, 2), (3, 3), (4, 4), (6, 6), (7, 7)]


def test_portions_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(30)]
    df = spark.createDataFrame([(i, "x y z " * 50 + items[i][1]) for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "PORTION", 500)
    assert sorted((r.doc_id, r.item_id) for r in decontamination.leak_digest(df, bench).collect()) == [(i, i) for i in range(30)]


def test_portions_give_the_same_scores(spark, monkeypatch):
    rnd = random.Random(3)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(rnd.choice([8, 12, 90])))) for i in range(40)] + [(98, ""), (99, None)]
    docs = [(i, " ".join(word() for _ in range(70)) + " " + x.rsplit(" ", 3)[0]) for i, x in items[:40]]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {(r.doc_id, r.item_id): r.score for r in decontamination.leak_digest(df, bench).collect()}
    whole = found()
    monkeypatch.setattr(decontamination, "PORTION", 1500)
    assert found() == pytest.approx(whole) and set(whole) >= {(i, i) for i, x in items[:40] if len(x) > 24}


def test_search_equals_full_scoring():
    rnd = random.Random(6)
    items = [(i, " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") + rnd.choice("xyz") for _ in range(rnd.randint(5, 30)))) for i in range(70)]
    index = decontamination.Index.build(items, 5)
    texts = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") + rnd.choice("xyz") for _ in range(n)) for n in (0, 3, 150, 700)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.r_[0, np.cumsum([len(x) for x in texts])]
    start, end, first = t.words(data, off, t.SIGNS)
    wh = t.word_hashes(data, start, end)
    weight = [dict(zip(index.terms[np.repeat(np.arange(len(index.terms)), np.diff(index.first))][index.item == i], index.impact[index.item == i], strict=True)) for i in range(len(index.ids))]
    want = set()
    for r in range(len(texts)):
        for a in range(int(first[r]), max(int(first[r]) + 1, int(first[r + 1])), index.passage // 2):
            seen = set(wh[a : min(a + index.passage, int(first[r + 1]))])
            want |= {(r, a, i) for i, w in enumerate(weight) if sum(v for k, v in w.items() if k in seen) >= 0.5}
    assert {(r, a, i) for r, a, _, i, _ in index.search(wh, first, 0.5)} == want and want


def sentences(lang, n, rnd):
    of = {"aa": ["the", "tion", "ing", "and"], "bb": ["der", "ung", "sch", "ß"], "cc": ["que", "ção", "los", "ñ"]}[lang]
    return " ".join("".join(rnd.choice(of) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def corpus(spark, n=240):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        lang = rnd.choice(["aa", "bb", "cc"])
        rows.append((i, sentences(lang, rnd.randint(20, 200), rnd), lang, "s", 1))
    return rows


def test_language_on_held_out_texts(spark, monkeypatch):
    rows = corpus(spark) + [(1000, None, "aa", "s", 0), (1001, "123 --", "aa", "s", 0), (None, "the tion ing and the", None, None, None), (1002, sentences("bb", 20_000, random.Random(1)), "bb", "s", 1), (1002, "der ung sch der ung", "bb", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    out = langid.language_digest(df).toPandas()
    truth = {r[0]: r[2] for r in rows}
    held = out[out.held_out & ~out.doc_id.isin([1000, 1001])]
    assert all(zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in held.doc_id)
    assert np.mean([truth[int(r.doc_id)] == r.lang_pred for r in held.itertuples()]) > 0.97
    und = out[out.doc_id.isin([1000, 1001])]
    assert set(und.lang_pred) == {"und"} and set(und.score) == {0.0} and out.score.between(0, 1).all()
    assert out[out.doc_id == 1002].lang_pred.tolist() == ["bb", "bb"] and len(out) == len(rows)
    assert langid.language_digest(df.limit(0)).count() == 0
    assert set(langid.language_digest(df.withColumn("lang", F.lit(None).cast("string"))).toPandas().lang_pred) == {"und"}


def test_windows_cover_every_byte():
    for n in (0, 1, 127, 128, 129, 1000):
        data = np.arange(n, dtype=np.uint64).astype(np.uint8)
        w, row, length = langid.windows_of(data, np.array([0, n]))
        assert length.sum() == n and np.concatenate([x[:k] for x, k in zip(w, length, strict=True)] or [data]).tolist() == data.tolist()


def test_quality_on_held_out_texts(spark):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good = rnd.random() < 0.8
        text = sentences("aa", rnd.randint(30, 150), rnd)
        rows.append((i, text if good else " ".join(w + rnd.choice(["%%%", "$$$"]) for w in text.split()), "aa", "s", 1))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(5000, None, None, None, None), (5001, "", "aa", "s", 0), (None, "x", "aa", "s", 0), (3, "the tion", "aa", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("label", F.lit(1))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (4, None, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_digest(df, lab).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    truth = {i: q for i, q, _ in labels}
    held = out[out.held_out & out.doc_id.isin(list(truth))]
    assert np.mean([truth[int(r.doc_id)] == r.predicted for r in held.itertuples()]) > 0.95
    assert quality.quality_digest(df.limit(0), lab).count() == 0
    assert set(quality.quality_digest(df, lab.limit(0)).toPandas().score) == {0.5}


def test_pipeline_keeps_clean_documents_once(spark, tmp_path):
    rnd = random.Random(10)
    texts = [sentences(rnd.choice(["aa", "bb"]), 60, rnd) for _ in range(60)]
    item = " ".join(f"quiz{k}" for k in range(20))
    rows = [(i, x, "aa" if "the" in x or "ing" in x else "bb", f"s{i % 3}", len(x)) for i, x in enumerate(texts)]
    rows += [(100, texts[0], "aa", "s0", 1), (101, texts[1] + " more", "aa", "s0", 1), (102, texts[2] + " " + item, "aa", "s1", 1), (103, "...", "aa", "s1", 1), (104, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumn("score", F.lit(1)), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = sorted(r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None)
        assert docs.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert seen["language"] == [*range(60), 100, 101, 102]
    assert set(seen["near_duplicates"]) >= set(range(60)) and 100 not in seen["near_duplicates"] and 101 not in seen["near_duplicates"]
    assert 102 not in seen["test_leaks"] and set(seen["test_leaks"]) >= set(range(60)) - {2}
    assert seen["mixture"] == seen["shards"] and max(seen["mixture"].count(i) for i in set(seen["mixture"])) <= 2
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == len(seen["shards"]) and out.select("shard").distinct().count() == 24
