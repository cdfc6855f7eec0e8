"""Text functions of records, citations and reports."""

from __future__ import annotations

import re
import unicodedata
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doi_normalise(col: Column) -> Column:
    """Bare lower-case DOI; NULL if nothing is left."""
    bare = F.regexp_replace(F.trim(col), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return F.nullif(F.lower(bare), F.lit(""))


def key_of_title(title: str | None) -> str | None:
    """Compatibility-normalised small letters and digits of a title."""
    return None if title is None else re.sub(r"[^\w]", "", unicodedata.normalize("NFKC", title).lower())


@F.pandas_udf(T.StringType())
def title_key(title: pd.Series) -> pd.Series:
    return title.map(key_of_title)


@F.pandas_udf(T.StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unescape(t))


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, "<[^>]+>", " ")


def inverted_index(words: Column) -> Column:
    """Map from the words of an array to their positions, from 0. Words are sorted with their positions, and
    runs of equal ones cut, within the row: no word leaves it. NULL for NULL."""
    placed = F.sort_array(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
    # bound once: what a lambda takes is computed for it, not for each use
    cut = F.transform(F.array(placed), lambda s: F.struct(s.alias("s"), F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1)["w"] != F.get(s, i - 2)["w"])).alias("at")))

    def entry(x: Column) -> Column:
        def one(i: Column, k: Column) -> Column:
            end = F.coalesce(F.get(x["at"], k + 1), F.size(x["s"]) + 1)
            return F.struct(F.get(x["s"], i - 1)["w"].alias("key"), F.transform(F.slice(x["s"], i, end - i), lambda y: y["p"]).alias("value"))

        return F.map_from_entries(F.transform(x["at"], one))

    return F.when(F.size(words) > 0, F.get(F.transform(cut, entry), F.lit(0))).when(words.isNotNull(), F.create_map().cast("map<string,array<int>>"))


def abstract_of(index: Column) -> Column:
    """Text of a map from words to their positions; NULL if there are none."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " "), F.lit(""))


def query_terms(col: Column) -> Column:
    """Small-letter words of more than one character."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(col), F.lit(r"(?U)\w+"), 0), lambda w: F.length(w) > 1))


def contains_any(texts: list[Column], terms: list[str]) -> Column:
    """Whether the texts, joined by spaces, contain one of the terms; case doesn't count."""
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(whole, t)) if terms else F.lit(False)


def citation_year(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, r"[（(]\s*(\d{4})\s*[）)]", 1), F.lit("")).cast("int")


def quoted_titles(col: Column) -> Column:
    """Titles in curly quotes, book brackets or straight quotes."""
    groups = F.transform(F.regexp_extract_all(col, F.lit(r'“[^”\n]+”|《[^》\n]+》|"[^"\n]+"'), 0), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return groups


def mask_secrets(col: Column) -> Column:
    """Keys of the form sk-... are replaced by [redacted]."""
    return F.regexp_replace(col, r"sk-[A-Za-z0-9_-]+", "[redacted]")


def valid_base_url(col: Column) -> Column:
    """http or https with a host and without user, query or fragment."""
    return F.coalesce(col.rlike(r"^https?://[^/?#@\s]+(/[^?#\s]*)?$"), F.lit(False))


def format_number(value: object) -> str:
    """Missing, whole or six significant digits."""
    if value is None:
        return "未估计"
    return str(value) if isinstance(value, int) else format(value, ".6g")


def display_number(value: float | None) -> str:
    """For tables: whole numbers as they are, extremes in scientific form, else four digits."""
    if value is None:
        return "—"
    if float(value).is_integer():
        return str(int(value))
    size = abs(value)
    return f"{value:.3e}" if size < 1e-3 or size >= 1e6 else f"{value:.4g}"


@F.pandas_udf(T.StringType())
def format_number_udf(value: pd.Series) -> pd.Series:
    return value.map(lambda v: format_number(None if v != v else v), na_action=None)


@F.pandas_udf(T.StringType())
def display_number_udf(value: pd.Series) -> pd.Series:
    return value.map(lambda v: display_number(None if v is None or v != v else v), na_action=None)


def json_set(text: Column, values: dict[str, Column]) -> Column:
    """A flat JSON object of texts with keys set; other texts stay as they are."""
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return _as_object(text, lambda m: F.map_concat(F.map_filter(m, lambda k, v: ~k.isin(list(values))), new))


def json_remove(text: Column, keys: list[str]) -> Column:
    return _as_object(text, lambda m: F.map_filter(m, lambda k, v: ~k.isin(keys)))


def json_move(text: Column, old: str, new: str) -> Column:
    """The value of ``old`` under the name ``new``, unless that is there already."""
    value = F.get_json_object(text, f"$.{new}")
    moved = json_remove(json_set(text, {new: F.coalesce(value, F.get_json_object(text, f"$.{old}"))}), [old])
    return F.when(F.get_json_object(text, f"$.{old}").isNotNull(), moved).otherwise(text)


def _as_object(text: Column, change) -> Column:
    own = F.from_json(text, "map<string,string>")
    return F.when(text.rlike(r"^\s*\{") & own.isNotNull(), F.to_json(change(own))).otherwise(text)


def hash_pick(text: Column, choices: list[str]) -> Column:
    """One of the choices by a rolling hash (times 31, modulo 2^32) of the text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % (1 << 32))
    return F.get(F.array(*[F.lit(c) for c in choices]), (h % len(choices)).cast("int"))


def base_url(col: Column) -> Column:
    """A valid base without slashes at its end; NULL for others."""
    return F.when(valid_base_url(col), F.regexp_replace(col, "/+$", ""))


def folded_sections(text: Column, keep: int, into: int) -> Column:
    """The first ``keep`` sections; those beyond are added to the body of section ``into`` (from 0)
    under headings of the third level."""
    own = sections(text)
    more = F.transform(F.slice(own, keep + 1, F.greatest(F.size(own) - keep, F.lit(0))), lambda s: F.concat(F.lit("\n\n### "), s["title"], F.lit("\n\n"), s["body"]))
    return F.transform(F.slice(own, 1, keep), lambda s, i: F.struct(s["title"].alias("title"), F.when(i == into, F.concat(s["body"], F.array_join(more, ""))).otherwise(s["body"]).alias("body")))


def inject(text: Column, numbers: Column) -> Column:
    """{{num:key}} replaced by the value of the key in a map of texts."""
    turn = lambda acc, e: F.replace(acc, F.concat(F.lit("{{num:"), e["key"], F.lit("}}")), e["value"])
    return F.aggregate(F.map_entries(numbers), text, turn)


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\{\{num:([a-zA-Z0-9_.]+)\}\}"), 1)


def same_placeholders(before: Column, after: Column) -> Column:
    """Whether an edit kept the sequence of placeholders."""
    return placeholders(before) == placeholders(after)


def sections(text: Column) -> Column:
    """Array of (title, body) of a Markdown text at its '## ' headings."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n## "), lambda x: F.lit(True))
    named = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(named, lambda s: F.struct(F.trim(F.substring_index(s, "\n", 1)).alias("title"), F.when(s.contains("\n"), F.trim(F.substring(s, F.length(F.substring_index(s, "\n", 1)) + 2, F.length(s)))).otherwise(F.lit("")).alias("body")))


def plain_title(text: Column) -> Column:
    """A heading without brackets, Chinese numbering, spaces, marks."""
    bare = F.regexp_replace(text, r"[（(][^）)]*[）)]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(bare), "^[一二三四五六七八九十]+、", ""), r"(?U)[\s#:：]", "")


def strip_repeated_heading(body: Column, title: Column) -> Column:
    """A body without a first heading that only repeats the section's title."""
    head = F.regexp_extract(body, r"^\s*#{1,6}[ \t]*([^\n]*)", 1)
    rest = F.regexp_replace(body, r"^\s*#{1,6}[ \t]*[^\n]*\n*", "")
    return F.when(body.rlike(r"^\s*#{1,6}") & (plain_title(head) == plain_title(title)), rest).otherwise(body)


def latex_to_code(col: Column) -> Column:
    r"""Inline formulas as code spans, displayed ones as code blocks."""
    shown = F.regexp_replace(col, r"(?s)\\\[\s*(.*?)\s*\\\]", "```text\n$1\n```")
    return F.regexp_replace(shown, r"\\\((.+?)\\\)", "`$1`")


def prefixed_list(items: Column, prefix: str) -> Column:
    """Trimmed parts of the item that begins with the prefix, split at list marks."""
    first = F.element_at(F.filter(items, lambda x: x.startswith(prefix)), 1)
    return F.filter(F.transform(F.split(F.substring(first, len(prefix) + 1, 1 << 30), "[、,，;；]"), lambda x: F.trim(x)), lambda x: x != "")
