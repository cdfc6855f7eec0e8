"""Leaks and host repeats against brute force; hostile pages."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, html_text

WORDS = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def words(text):
    return WORDS.findall((text or "").lower())


def leaks(docs, items, n=5, threshold=0.5, cover=0.6):
    """doc, item, score, shares of question and answer; parts have n words or more."""
    known = [(k, words(x), x) for k, x in items if words(x)]
    df = Counter(w for _, ws, _ in known for w in set(ws))
    mean, largest = sum(len(ws) for _, ws, _ in known) / len(known), max(len(ws) for _, ws, _ in known)
    passage, out = 2 * max(64, largest + 2 * n), {}
    for doc, text in docs:
        all_words = words(text)
        for a in range(0, len(all_words), passage // 2):
            part = all_words[a : a + passage]
            seen, runs = set(part), {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
            for key, ws, item in known:
                weight = {w: math.log(1 + (len(known) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, c in Counter(ws).items()}
                score = sum(v for w, v in weight.items() if w in seen) / sum(weight.values())
                if score < threshold:
                    continue
                covered = [False] * len(ws)
                for i in range(len(ws) - n + 1):
                    if tuple(ws[i : i + n]) in runs:
                        covered[i : i + n] = [True] * n
                cut = len(words(item[: item.rfind("?")])) if "?" in item else len(ws)
                q, ans = covered[:cut], covered[cut:]
                q = sum(q) / len(q)
                ans = sum(ans) / len(ans) if ans else q
                if min(q, ans) >= cover and score > out.get((doc, key), (0,))[0]:
                    out[doc, key] = (score, q, ans)
    return out


@pytest.mark.parametrize("portion", [500, 8 << 20])
def test_leaks_equal_brute_force(spark, monkeypatch, portion):
    monkeypatch.setattr(decontamination, "PORTION", portion)
    monkeypatch.setattr(decontamination, "HELD", 3)
    rnd = random.Random(12)
    some = lambda k, of=30: " ".join(f"w{rnd.randrange(of)}" for _ in range(k))
    items = [(i, some(rnd.randint(5, 12)) + "? " + some(rnd.randint(5, 12), 60)) for i in range(50)] + [(50 + i, some(rnd.randint(5, 70))) for i in range(20)]
    items += [(90, items[3][1])]
    docs = [(i, some(rnd.randint(0, 300))) for i in range(30)]
    for i, (_, x) in enumerate(items):
        ws = x.replace("?", " ").split()
        for _ in range(rnd.randint(0, 4)):  # copies with changed words
            ws[rnd.randrange(len(ws))] = some(1)
        docs.append((100 + i, some(rnd.randint(0, 200)) + " " + " ".join(ws) + " " + some(rnd.randint(0, 200))))
    want = leaks(docs, items)
    got = decontamination.leak_digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(want) and len(got) == len(want) > 40
    for r in got:
        assert (r.score, r.question_overlap, r.answer_overlap) == pytest.approx(want[r.doc_id, r.item_id])


@pytest.mark.parametrize("hot", [2000, 5])
def test_host_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(html_text, "HOT", hot)
    rnd, run = random.Random(13), html_text.RUN
    shared = [[f"s{k}_{j}" for j in range(rnd.randint(run - 2, run + 9))] for k in range(6)]
    rows = []
    for page in range(30):
        tokens = []
        for _ in range(rnd.randint(1, 6)):
            tokens += rnd.choice(shared)[rnd.randint(0, 3) :] if rnd.random() < 0.6 else ["x"] * rnd.randint(1, 15) if rnd.random() < 0.2 else [f"o{page}_{rnd.randrange(10**6)}" for _ in range(rnd.randint(1, 12))]
        rows.append((rnd.choice(["h", "g"]), page, tokens))
    where = {}
    for host, page, tokens in rows:
        for i in range(len(tokens) - run + 1):
            where.setdefault((host, *tokens[i : i + run]), set()).add(page)
    df = spark.createDataFrame([(h, p, [" ".join(x[: len(x) // 2]), " ".join(x[len(x) // 2 :])]) for h, p, x in rows], "host string, page long, blocks array<string>")
    gone = {(r.host, r.page): {k for s in r.spans for k in range(s.begin, s.finish)} for r in html_text.host_spans(df).collect()}
    for host, page, tokens in rows:
        hits = [i for i in range(len(tokens) - run + 1) if len(where[(host, *tokens[i : i + run])]) > 1]
        assert gone.get((host, page), set()) == {k for i in hits for k in range(i, i + run)}
    assert gone


@pytest.mark.parametrize("hot", [2000, 3])
def test_marked_pages_pass_through_the_array(spark, monkeypatch, hot):
    """Runs that pages of a host share in their marked main text are counted, and page structure keeps them."""
    monkeypatch.setattr(html_text, "HOT", hot)
    rnd, run = random.Random(15), html_text.RUN
    word = lambda: f"w{rnd.randrange(10**6)}"
    common = [[word() for _ in range(rnd.randint(run - 1, 30))] for _ in range(5)]
    rows, own = [], {}
    for page in range(60):
        words = []
        for _ in range(rnd.randint(1, 5)):
            words += rnd.choice(common)[rnd.randint(0, 2) :] if rnd.random() < 0.5 else [word() for _ in range(rnd.randint(1, 25))]
        host = rnd.choice(["g.org", "h.org"])
        own[page] = host, words
        rows.append((page, f"http://{host}/{page}", f"<nav>Menu</nav><p>Beside {' '.join(common[0])}</p><article><p>{' '.join(words)}</p></article>"))
    rows += [rows[0], (90, "http://h.org/90", f"<p>Own {' '.join(common[0])}</p>"), (91, "http://h.org/91", None)]
    where = {}
    for page, (host, words) in own.items():
        for i in range(len(words) - run + 1):
            where.setdefault((host, *words[i : i + run]), set()).add(page)
    want = {90: ("Own", 0), 91: ("", 0)}
    for page, (host, words) in own.items():
        hits = [i for i in range(len(words) - run + 1) if len(where[(host, *words[i : i + run])]) > 1]
        want[page] = " ".join(words), len({k for i in hits for k in range(i, i + run)})
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 63 and sum(n for _, n in want.values()) > 500
    assert {r.page_id: (r.text, r.n_shared) for r in got} == want


def test_pages_without_article_marks_keep_unique_text(spark):
    """The array decides: of pages that mark nothing, template lines go and own lines stay."""
    rnd = random.Random(14)
    line = lambda k: " ".join(f"{rnd.choice('bcdfg')}{rnd.randrange(9**6)}" for _ in range(k))
    template = {h: (line(16), line(24)) for h in "pqr"}
    rows, want = [], {}
    for page in range(120):
        host, own = "pqr"[page % 3], [line(rnd.randint(12, 60)) for _ in range(3)]
        top, bottom = template[host]
        rows.append((page, f"https://{host}.org/{page}", f"<div>{top}</div>" + "".join(f"<p>{x}</p>" for x in own) + f"<div>{bottom}</div>"))
        want[page] = "\n".join(own)
    assert {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want


def test_hostile_pages_take_linear_time():
    mb = 1 << 20
    pages = ["<a " * (mb // 3), "<div>" * (mb // 5) + "</span>" * 9000, '<a ">" ' * (mb // 7), "<a '\">x" * (mb // 7), "<script></script " * (mb // 17), "<!-- " * (mb // 5), "<" * mb, "&#" + "1" * mb, "&#" + "0" * mb + "65;", "<p></b>" * (mb // 7), "<p " + "a=' " * (mb // 4) + ">", "<p style='" + "display   " * (mb // 10) + "'>x", "<p class='" + "a-" * (mb // 2) + "'>x", "<article>x" * (mb // 10), "<textarea>" * (mb // 10)]
    for page in pages:
        start = time.monotonic()
        html_text.split(page)
        assert time.monotonic() - start < 5, page[:20]
    assert html_text.split("a &#65; b &#99999999999; <x> 1 < 2 <b")[1] == ["a A b � 1 < 2 <b"]
    assert html_text.split("<p>a</p><p class=\"x>b</p><p>c</p>")[1] == ["a", "b", "c"]


def test_cards_beside_the_article_are_left_out():
    story, card = "the long story " * 9, '<article class="card"><a href="/2"><h3>Other</h3><p>news</p></a></article>'
    assert html_text.split(f"<main><article><p>{story}</p></article>{card}</main>")[0] == [story.strip()]
    assert html_text.split(f"<article><p>{story} <a>link</a></p></article><article>second</article>")[0] == [f"{story} link".replace("  ", " "), "second"]
    assert html_text.split("<!-- <main> --><div>menu</div><main-nav><p>body</p></main-nav>") == (None, ["menu", "body"])


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.main_text(pages.withColumn("host", F.lit(1))).count() == 0
