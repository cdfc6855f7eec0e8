"""License scan: a positional index of rare license words over templates of notices.

The index lists, for each word of the templates, the templates and places it stands at. Document
frequencies of these words are counted over all documents. A file is looked at for a template if it
holds every word of the template's mandatory key phrases, of which the rarest is looked for first. The
up to RARE words of the template with the highest inverse document frequency that the file holds
are looked up; a place of the file less the place of its posting is a relative position, and positions
on which at least AGREE of them agree (all, if they are fewer), give or take SLACK words, are checked
in full: ``coverage`` is the share of the template's words that stand where they should, give or take
SLACK, and each key phrase must stand whole where it should. COVERAGE makes a match; of several
places the one covered best counts, then the first. Words are found by comparing bytes, not hashes.

Beside templates, four base phrases are looked for at every place. The score is the best coverage of
a match, at least MENTION where a base phrase stands, else 0.

The vocabulary is that of the templates, so what is counted for it and sent to tasks is bounded by
them and doesn't grow with the corpus.

Defined results: a null or empty text has no words, places or labels; texts are read whole; repeated
rows get equal results, however often they stand; ties between words of equal frequency go by spelling; an
empty table gives no rows. ``scan`` carries other columns along and replaces one that is called as its
result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textnum as t

RARE, AGREE, SLACK = 8, 3, 3
COVERAGE, MENTION = 0.6, 0.5

# Phrases that are counted everywhere, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # phrases of the text that must stand


# Notices by which licenses are granted, and the phrases that tell them from each other.
TEMPLATES = (
    Template("mit", "released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("apache-2.0", "licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "either version 2 of the license", "any later version")),
    Template("gpl-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "either version 3 of the license", "any later version")),
    Template("lgpl-2.1", "licensed under the GNU Lesser General Public License, version 2.1", ("gnu lesser general public license", "version 2 1")),
    Template("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license", "version 3")),
    Template("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license", "version 3")),
    Template("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    Template("cc-by-4.0", "this work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    Template("cc0-1.0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0 universal",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
)

MATCH = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("coverage", T.DoubleType())]))
LICENSES = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("matches", MATCH),
])


def words_of(text: str) -> list[str]:
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = t.words(data, np.array([0, len(data)]), t.SIGNS)
    return [t.LOWER[data[a:b]].tobytes().decode() for a, b in zip(start, end, strict=True)]


class Index:
    """Vocabulary and postings of templates, with words as numbers in order of spelling."""

    def __init__(self, templates: Sequence[Template]) -> None:
        texts = [words_of(x.text) for x in templates]
        keys = [[words_of(k) for k in x.keys] for x in templates]
        base = [words_of(k) for k in BASE]
        self.vocabulary = sorted({w for x in [*texts, *base] for w in x})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.labels = [x.label for x in templates]
        self.texts = [np.array([number[w] for w in x], np.int32) for x in texts]
        self.base = [np.array([number[w] for w in x], np.int32) for x in base]
        self.keys: list[list[tuple[np.ndarray, int]]] = []  # key phrases with their place in the template
        for x, own in zip(self.texts, keys, strict=True):
            found = []
            for k in own:
                at = _places(x, np.array([number.get(w, -1) for w in k], np.int32))
                if not len(at):
                    raise ValueError(f"a key phrase is not in its template: {' '.join(k)}")
                found.append((x[at[0] : at[0] + len(k)], int(at[0])))
            self.keys.append(found)
        self.needed = [np.unique(np.concatenate([k for k, _ in own])) for own in self.keys]
        # postings: for each word its templates and places
        self.postings = [[np.flatnonzero(x == w) for x in self.texts] for w in range(len(self.vocabulary))]

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        ends = np.r_[0, np.cumsum(end - start)]
        flat = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(t.LOWER[data[~t.SIGNS[data]]])])
        return pc.index_in(flat, pa.array([w.encode() for w in self.vocabulary], pa.large_binary())).fill_null(-1).to_numpy(zero_copy_only=False)


def _places(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of the phrase stand one after another."""
    n = len(words) - len(phrase) + 1
    if n < 1:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[words[at + k] == phrase[k]]
    return at


def _covered(words: np.ndarray, template: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For relative positions, in portions: where each word of the template stands, or -1."""
    padded = np.r_[np.full(SLACK, -2, np.int32), words, np.full(SLACK, -2, np.int32)]
    portion = max(1, 1_000_000 // len(template))
    for c in range(0, len(at), portion):
        own = at[c : c + portion]
        place = own[:, None] + np.arange(len(template))
        found = np.full(place.shape, -1)
        for s in sorted(range(-SLACK, SLACK + 1), key=abs):
            there = np.clip(place + s, -SLACK, len(words) + SLACK - 1)
            hit = (found < 0) & (padded[there + SLACK] == template)
            found[hit] = there[hit]
        yield own, (found >= 0).mean(1), found


def match(index: Index, k: int, words: np.ndarray, df: np.ndarray, held: np.ndarray) -> tuple[float, int, int] | None:
    """Coverage, first and last word of the best place of template k, if there is one. held: the
    distinct numbers of the words."""
    template = index.texts[k]
    own = np.intersect1d(template, held)
    rare = own[np.lexsort((own, df[own]))][:RARE]
    turns = [np.unique((np.flatnonzero(words == w)[:, None] - index.postings[w][k][None, :]).ravel()) for w in rare]
    at = np.unique(np.concatenate(turns))
    votes = sum((np.searchsorted(x, at + SLACK, "right") > np.searchsorted(x, at - SLACK, "left")).astype(np.int64) for x in turns)
    at = at[votes >= min(AGREE, len(rare))]
    for phrase, place in index.keys[k]:
        there = _places(words, phrase) - place
        at = at[np.searchsorted(there, at + SLACK, "right") > np.searchsorted(there, at - SLACK, "left")]
    best = None
    for places, coverage, found in _covered(words, template, at):
        i = int(np.lexsort((places, -coverage))[0])
        if coverage[i] >= COVERAGE and (best is None or coverage[i] > best[0]):
            stands = found[i][found[i] >= 0]
            best = (float(coverage[i]), int(stands.min()), int(stands.max()))
    return best


def _frequencies(index: Index):
    """word, df: in how many texts of the batch a word stands; word -1 for the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, texts = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for i, j, data, off in t.column_blocks(batch.column(0)):
                start, end, first = t.words(data, off, t.SIGNS)
                number = index.numbers(data, start, end)
                known = np.flatnonzero(number >= 0)
                seen = np.zeros((j - i, len(df)), bool)
                seen[np.searchsorted(first, known, "right") - 1, number[known]] = True
                df += seen.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(len(df))].astype(np.int32)), pa.array(np.r_[texts, df])], ["word", "df"])

    return run


def document_frequencies(texts: DataFrame, index: Index) -> np.ndarray:
    """Of each word of the templates, which bound what comes to the driver."""
    counted = texts.mapInArrow(_frequencies(index), "word int, df long").groupBy("word").agg(F.sum("df").alias("df"))
    df = np.zeros(len(index.vocabulary), np.int64)
    for word, n in counted.where("word >= 0").collect():
        df[word] = n
    return df


def _scanned(index: Index, df: np.ndarray, names: list[str], text_at: int, out_col: str):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(LICENSES)
    base_labels = list(BASE.values())
    anchors = np.array([own[np.lexsort((own, df[own]))[0]] for own in index.needed])
    is_anchor = np.zeros(len(index.vocabulary) + 1, bool)  # the last: of no word
    is_anchor[anchors] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for i, j, data, off in t.column_blocks(batch.column(text_at)):
                start, end, first = t.words(data, off, t.SIGNS)
                number = index.numbers(data, start, end)
                rows = [{"n_words": int(n), "n_base": 0, "first_word": None, "last_word": None, "base_labels": set(), "labels": set(), "score": 0.0, "matches": []} for n in np.diff(first)]
                for label, phrase in zip(base_labels, index.base, strict=True):
                    at = _places(number, phrase)
                    row = np.searchsorted(first, at, "right") - 1
                    inside = at + len(phrase) <= first[row + 1]
                    for r, place in zip(row[inside].tolist(), (at - first[row])[inside].tolist(), strict=True):
                        x = rows[r]
                        x["n_base"] += 1
                        x["first_word"] = place if x["first_word"] is None else min(place, x["first_word"])
                        x["last_word"] = place if x["last_word"] is None else max(place, x["last_word"])
                        x["base_labels"].add(label)
                        x["score"] = MENTION
                for r in np.unique(np.searchsorted(first, np.flatnonzero(is_anchor[number]), "right") - 1).tolist():
                    words = number[first[r] : first[r + 1]]
                    held = np.unique(words[words >= 0])
                    for k, needed in enumerate(index.needed):
                        if np.isin(needed, held).all() and (found := match(index, k, words, df, held)):
                            coverage, a, b = found
                            rows[r]["labels"].add(index.labels[k])
                            rows[r]["score"] = max(rows[r]["score"], coverage)
                            rows[r]["matches"].append({"label": index.labels[k], "first_word": a, "last_word": b, "coverage": coverage})
                for x in rows:
                    x["labels"] = ",".join(sorted(x["labels"] | x["base_labels"]))
                    x["base_labels"] = ",".join(sorted(x["base_labels"]))
                out += rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*names, out_col])

    return run


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text_col: str = "text", out_col: str = "licenses") -> DataFrame:
    """``docs`` with a struct of LICENSES; matches lists the templates with the words they span."""
    docs = docs.drop(out_col)
    index = Index(templates)
    df = document_frequencies(docs.select(text_col), index)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, LICENSES)])
    return docs.mapInArrow(_scanned(index, df, docs.columns, docs.columns.index(text_col), out_col), schema)


def license_digest(docs: DataFrame) -> DataFrame:
    """The columns of op11."""
    return scan(docs.select("doc_id", "text")).select("doc_id", *[f"licenses.{c}" for c in LICENSES.fieldNames() if c != "matches"])


def _listed(words: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def oracle(templates: Sequence[Template] = TEMPLATES) -> str:
    """SQL for the same rows, which reads every place near a key phrase instead of looking up rare words."""
    texts = [words_of(x.text) for x in templates]
    keys = [(k, n, words_of(key), next(i for i in range(len(w)) if w[i : i + len(words_of(key))] == words_of(key))) for k, (x, w) in enumerate(zip(templates, texts, strict=True)) for n, key in enumerate(x.keys)]
    return rf"""
WITH t AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{x.label}', {len(x.keys)}, {_listed(w)})" for k, (x, w) in enumerate(zip(templates, texts, strict=True)))}) v(k, label, n_keys, x)),
ky AS (SELECT * FROM (VALUES {', '.join(f'({k}, {n}, {_listed(w)}, {at})' for k, n, w, at in keys)}) v(k, nth, p, pos)),
bs AS (SELECT * FROM (VALUES {', '.join(f"('{label}', {_listed(words_of(phrase))})" for phrase, label in BASE.items())}) v(label, p)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
j AS MATERIALIZED (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d),
b AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1:i + len(p)] = p)) AS place FROM j, bs WHERE contains(s, ' ' || array_to_string(p, ' ') || ' ')),
bb AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY doc_id),
kp AS MATERIALIZED (SELECT doc_id, k, nth, pos, list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1:i + len(p)] = p) AS places FROM j, ky WHERE contains(s, ' ' || array_to_string(p, ' ') || ' ')),
o AS (SELECT DISTINCT doc_id, k, place - pos + s.range AS o FROM (SELECT doc_id, k, pos, unnest(places) AS place FROM kp WHERE nth = 0), range({-SLACK}, {SLACK + 1}) s),
ok AS (SELECT o.doc_id, o.k, o.o FROM o JOIN kp ON kp.doc_id = o.doc_id AND kp.k = o.k JOIN t ON t.k = o.k GROUP BY o.doc_id, o.k, o.o, n_keys HAVING count(*) = n_keys AND min(len(list_filter(places, lambda i: abs(i - pos - o.o) <= {SLACK}))) > 0),
c AS (SELECT ok.doc_id, label, len(list_filter(range(0, len(x)), lambda q: list_contains(w[greatest(o + q + 1 - {SLACK}, 1):greatest(o + q + 1 + {SLACK}, 0)], x[q + 1])))::DOUBLE / len(x) AS coverage FROM ok JOIN j ON j.doc_id = ok.doc_id JOIN t ON t.k = ok.k),
m AS (SELECT doc_id, max(coverage) AS best, list(DISTINCT label) AS found FROM c WHERE coverage >= {COVERAGE} GROUP BY doc_id)
SELECT j.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels, greatest(coalesce(best, 0.0), CASE WHEN n_base > 0 THEN {MENTION} ELSE 0.0 END)::DOUBLE AS score
FROM j LEFT JOIN bb ON bb.doc_id = j.doc_id LEFT JOIN m ON m.doc_id = j.doc_id"""
