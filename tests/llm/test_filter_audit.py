"""The audit of filters against a plain count of every document in every order."""

from __future__ import annotations

import re
from itertools import permutations

from tessera.llm import filter_audit

DOCS = "doc_id long, text string, lang string, k1 string, n string"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    good, toxic, ids = set(), set(), {}
    for i, q, t in labels:
        if i is not None:
            good |= {i} if q == 1 else set()
            toxic |= {i} if t == 1 else set()
    for i, text, *_ in docs:
        if i is not None:
            ids[text or ""] = min(i, ids.get(text or "", i))
    fails = []
    for i, text, lang, *_ in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and ids[text] < i}
        fails.append((lang or "", f, i in good, i in toxic))
    out = {}
    for part in {x[0] for x in fails}:
        own = [x for x in fails if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order):
                gone, left = [x for x in left if x[1][c]], [x for x in left if not x[1][c]]
                shapley[c] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(x[1][c] for x in own) - len(gone), sum(x[1][c] and sum(x[1].values()) == 1 for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for order in permutations("ABCDE"):
            for step, c in enumerate(order):
                out[part, "".join(order), step + 1].append(shapley[c])
    return out


def check(spark, docs, labels):
    rows = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(got) == len(rows)
    assert got == plain(docs, labels)


def test_nulls_repeats_ties_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, long, "en"), (2, long, "en"), (2, long, "de"), (3, long, None), (None, long, "en"), (None, long, ""), (4, "A B C", "en"), (5, None, None), (6, "", "en"), (7, "x $ " * 200, "de"), (8, "y|" + long, "de"),
        (8, "y|" + long, "de"), (0, "é" * 9 + "A", "fr"), (9, "a b\u0085c " * 150, "fr"), (10, "\t\n\x0b\x0c\r ", "fr"), (11, ("q" * 50 + " ") * 40_000, "xx"), (-5, "same", "a"), (-5, "same", "b"), (12, "same", "a"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (12, 1, 1), (7, None, 1), (99, 1, 1)]
    check(spark, [(*r, "clash", "n") for r in rows], labels)


def test_empty_tables(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    check(spark, [(1, "a", "en", None, None)], [])


def test_parts_sum_to_every_document(spark):
    docs = [(i, ("UP " if i % 3 == 0 else "") + " ".join(f"w{(i * j) % (7 + i % 200)}" for j in range(i % 150)) + ("#" if i % 5 == 0 else ""), ["en", "de", None][i % 3], None, None) for i in range(300)]
    check(spark, docs + [(i + 1000, d, l, None, None) for i, d, l, *_ in docs[:90]], [(i, i % 2, int(i % 7 == 0)) for i in range(300)])
