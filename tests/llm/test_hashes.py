"""Hashes that tell the words of a Thue-Morse sequence apart, and what rests on them."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import decontamination, html_text, ngram_join, suffix_dedup
from tessera.llm import textnum as t


def thue_morse(n, a="a", b="b"):
    x = a
    y = b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def test_hashes_of_strings():
    texts = ["", "a", "ab", "ba", "a\0", "a\0\0", "é", "abcdefgh", "abcdefghi", "x" * 64, "x" * 65, "x" * 512, "x" * 513, "x" * 1000, *[w for n in (16, 64, 1024, 2048) for w in thue_morse(n)], *[w for n in (16, 64, 1024) for w in thue_morse(n, "ab", "cd")]]
    raw = [x.encode() for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(r) for r in raw])
    start = end - np.array([len(r) for r in raw])
    h = t.string_hashes(data, start, end)
    assert len(set(h.tolist())) == len(texts)
    again = np.frombuffer(b"zz" + b"".join(raw) + b"zz", np.uint8)
    assert (t.string_hashes(again, start + 2, end + 2) == h).all()
    assert (t.word_hashes(np.frombuffer(b"AbC abc", np.uint8), np.array([0, 4]), np.array([3, 7])) == t.word_hashes(np.frombuffer(b"abc", np.uint8), np.array([0]), np.array([3]))).all()
    assert len(t.string_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_complements_are_not_near(spark, n):
    one, two = thue_morse(n)
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_classes(docs).collect()}
    assert got == {1: (1, 1), 2: (2, 0), 3: (1, 1)}
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == [1, 2]


def test_a_complement_is_no_leak(spark):
    one, two = thue_morse(2048)
    rest = "what word is this among many other words of the question? answer: "
    bench = spark.createDataFrame([(1, rest + one)], "item_id long, text string")
    docs = spark.createDataFrame([(1, two + " and then something else entirely"), (2, "so: " + rest + one)], "doc_id long, text string")
    assert [r.doc_id for r in decontamination.leak_digest(docs, bench).collect()] == [2]


def test_complements_are_not_repeats(spark):
    one, two = thue_morse(4096)
    docs = spark.createDataFrame([(1, one), (2, two), (3, one + "tail")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_digest(docs).collect()}

    def removed(i):
        texts, seen, out = [one, two, one + "tail"], set(), []
        for x in texts:
            gone = set()
            for p in range(len(x) - 99):
                if x[p : p + 100] in seen:
                    gone.update(range(p, p + 100))
                seen.add(x[p : p + 100])
            out.append(len(gone))
        return out[i]

    assert got == {1: removed(0), 2: removed(1), 3: removed(2)}


WRAPPERS = ["<div class='content-sidebar-wrap'>", "<div id='page' class='site no-sidebar'>", "<div class='layout header-fixed'>", "<div class='search-results'>", "<div class='has-cookie-banner'>", "<div class='form-group'>", "<form id='aspnetForm'><label>Name</label><button>Go</button>", "<div role='dialog'>", "<section class='related'>"]
STORY = "<h1>Head</h1><p>" + "The main text goes on. " * 12 + "</p>"
PLAIN = "Head\n" + " ".join(["The main text goes on."] * 12)


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("mark", ["article", "main"])
def test_wrappers_do_not_take_the_main_text(wrapper, mark):
    inner = f"<{mark}>{STORY}<div class='share-buttons'>Share this</div></{mark}>"
    around = "<div class='sidebar'>Side words</div>{}<div id='comments'>" + "A long and loud comment. " * 60 + "</div>"
    close = "</form>" if wrapper.startswith("<form") else "</section>" if wrapper.startswith("<section") else "</div>"
    for page in (around.format(wrapper + inner + close), around.format(wrapper + wrapper + inner + close + close)):
        assert "\n".join(html_text.split(f"<html><body>{page}</body></html>")[0]) == PLAIN


def test_wrappers_with_names_at_random():
    rng = np.random.default_rng(2)
    words = sorted(html_text.ALL_PARTS | html_text.COMPOUNDS) + ["js", "has", "no", "l", "is", "x2"]
    for _ in range(300):
        depth = int(rng.integers(1, 5))
        names = [" ".join("-".join(rng.choice(words, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(1, 3)))) for _ in range(depth)]
        key = rng.choice(["class", "id"])
        page = "".join(f'<div {key}="{n}">' for n in names) + f"<article>{STORY}</article>" + "</div>" * depth
        assert "\n".join(html_text.split(f"<body><nav>Menu</nav>{page}<p>Other words.</p></body>")[0]) == PLAIN, names


def test_pages_without_marks_keep_what_most_text_stands_in():
    for wrapper in ("<div class='has-sidebar'>", "<form>", "<div class='search-results'>"):
        main, rest = html_text.split(f"<body>{wrapper}{STORY}{'</form>' if 'form>' in wrapper else '</div>'}<div class='sidebar'>Side</div></body>")
        assert main is None and rest == PLAIN.split("\n")
    # an article that only one named part makes up keeps it
    assert html_text.split(f"<article><div class='post-sidebar'>{STORY}</div></article>")[0] == PLAIN.split("\n")
