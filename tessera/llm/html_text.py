"""Main text of web pages: a suffix array over each host, checked by page structure.

A page is read as a stream of tags and text with a stack of open elements. Elements that are not
main text by name (menus, site headers, footers, scripts, styles, hidden parts) are left out; forms and
what roles, classes and ids name as such (sidebars, notices, adverts, reader comments) are left out, too,
unless it turns out that they are wrapped around the main text: nothing that holds main or the largest article
goes. Block elements and line breaks end blocks. Inside an article or main part, names must say so as a
whole ("related-posts", not "related-work"), and ids of headings, and single words as ids of sections and paragraphs, are slugs
of what stands there and don't count. Where the page marks its main text, that is taken whole:
repeats inside it are the author's, and copies of an article on other pages must not remove it.
Articles are it if the largest holds at least half of the text of all articles and main, else main
is; without main, articles are it if they hold at least half of the text of the page. Articles
beside the largest whose text is a link for four fifths are cards and left out.

All pages go to the host suffix array, in two streams: marked main text, and the blocks besides it,
which of a page without marks are all. Token streams of a kind and host, joined with marks between
them, are sorted by suffix; runs of at least RUN tokens that distinct pages share are proposed as
boilerplate. Then page structure is the check. On pages without marks the proposed runs are removed and
unique ones stay; what pages that do mark their main text have besides it is evidence there. In marked
main text the proposal is refused, as an article on two pages is still the article: nothing is removed,
and ``n_shared`` counts the words of the text that it named.

A host may hold a third of all pages, so its streams are cut where they can't miss a repeat: every
window of RUN tokens belongs to its smallest hash of PIECE tokens, windows in a row with one such anchor
form a segment, equal segments are one string with its smallest and largest page, and the strings of an
anchor meet in one array. Where an anchor has over HOT different strings, they are cut into
single windows, which split further by content. A segment alone with its anchor shares nothing, so pages
are cut twice: once to see which anchors repeat and which of them have different strings, packed to eight
bytes a segment; and once to keep the segments of the former, with tokens for the latter, as equal strings
need no array. What the second cut is told are bits of hashes, so it may keep too much, never too little,
but for strings of an anchor that differ and are equal in 36 bits, which are judged one by one.

Defined results: null or empty html gives an empty text; character references are decoded once;
white space in a block becomes one space; unclosed elements end with their parent; a page without
host is on the host ''. Repeated rows of one page are one page to the suffix array (equal id and
html); a null id is a page of its own. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textnum as t
from tessera.llm.shared import by_runs
from tessera.operators.tables import written

RUN, PIECE, HOT = 10, 4, 2000
OUTSIDE, INSIDE = "0", "1"
#: Buckets of hashes by their first BITS bits, bits of a bucket's table, and words that are packed at a time.
BITS, MOST_BITS, PACKED = 10, 1 << 19, 1 << 20
MOST_SEEN = 500_000
U = np.uint64

MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]+|"[^"]*"|'[^']*')*+)>""")
BLIND_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Decimal references that are too long for a number.
ZEROS, TOO_LARGE = re.compile("&#0{9,}+"), re.compile("&#0*+[1-9][0-9]{7,};?")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
SKIPPED = frozenset("head nav footer aside button select option object audio video map menu annotation annotation-xml".split()) | RAW
#: Left out outside of article and main only; a dialog that isn't open is hidden anywhere.
OUTER_SKIPPED = frozenset("header label fieldset svg canvas dialog".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td text tfoot th thead tr ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of class and id that mark parts outside the main text; the second list counts outside of
#: article and main only.
PARTS = frozenset("ad ads adbox adsense advert advertisement advertising adverts sponsor sponsored sponsors promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer notice notices cookie cookies consent gdpr newsletter subscribe signup popup modal overlay share sharing social comment comments commentlist disqus replies respond related recommended pagination pager widget form login search skip hidden".split())
OUTER_PARTS = frozenset("header masthead banner alert topbar".split())
ALL_PARTS = PARTS | OUTER_PARTS
#: Words that with words of PARTS make up a whole name of such a part.
COMPOUNDS = frozenset("area article articles bar block body box button buttons column container content entry field footer group header icon icons inner item items left link links list main menu module outer page panel placeholder post posts right section site slot stories sub tags thread title top bottom unit wrap wrapper".split())
#: Doubtful elements around a text that are told apart; what stands deeper shares their lot.
MOST_DOUBTS = 64
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SLUGGED = frozenset("section p dt li".split())
#: Elements that an opening tag of the same kind closes.
SIBLINGS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"br", "body", "html", "head", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "p", "text"}


def _names_part(value: str, single: bool, parts: frozenset[str] = PARTS) -> bool:
    """Whether a whole class name or id names a part outside the main text. ``single``: by one
    word, too."""
    words = [w for w in re.split(r"[_-]+", value) if w]
    return (single or len(words) > 1) and any(w in parts for w in words) and all(w in parts or w in COMPOUNDS or w.isdigit() for w in words)


def _doubt(name: str, attributes: str, inside: bool) -> str:
    """What speaks against an element: "" nothing; "out" that it is outside the main text whatever it
    holds; else what its text decides on: that it is a form, that a role or a whole name says so, or that a
    part of a name does. ``inside``: of article or main."""
    if name in SKIPPED or (name in OUTER_SKIPPED and not inside):
        return "out"
    if name == "dialog" and not re.search(r"(?i)(?:^|\s)open(?:[\s=/]|$)", attributes):
        return "out"
    kind = "form" if name == "form" else ""
    if name in ("html", "body", "main") or ("=" not in attributes and "hidden" not in attributes.lower()):
        return kind
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return "out"
        if key == "role" and value in ROLES:
            kind = kind or "named"
        if key == "class" or (key == "id" and name not in HEADINGS):
            if inside:
                whole, some = any(_names_part(v, key == "class" or name not in SLUGGED) for v in value.split()), False
            else:
                whole, some = any(_names_part(v, True, ALL_PARTS) for v in value.split()), not ALL_PARTS.isdisjoint(re.split(r"[\s_-]+", value))
            kind = "named" if whole and kind in ("", "hinted") else "hinted" if some and not kind else kind
    return kind


def _decoded(text: str) -> str:
    """Character references decoded once; numbers beyond all characters as browsers show them."""
    if "&#" in text:
        text = TOO_LARGE.sub("\N{REPLACEMENT CHARACTER}", ZEROS.sub("&#0", text))
    return unescape(text)


def _after(html: str, mark: str, at: int) -> int:
    """The place behind the next mark, or the end."""
    k = html.find(mark, at)
    return len(html) if k < 0 else k + len(mark)


@lru_cache(maxsize=None)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I)


def _left_out(pieces: list, doubts: list) -> set[int]:
    """Which of the doubtful elements are outside the main text. pieces: (in main, article, text,
    its length without space, ..., doubtful elements around it).

    Never one that holds main, the article with most text or all but a twentieth of its article's text; of the
    others, one that a part of a name speaks against goes if it has less than a third of the page's text, and
    the rest go, but for one with two thirds of a page that marks no main text."""
    if not doubts:
        return set()
    sizes, of_article, total, marked = Counter(), Counter(), 0, False
    for main, article, _, size, _, around in pieces:
        total += size
        of_article[article] += size
        marked = marked or main or article > 0
        for k in around:
            sizes[k] += size
    of_article[0] = 0
    largest = max(of_article, key=of_article.get)
    out = set()
    for k, (kind, where, main, articles) in enumerate(doubts):
        if main or (largest and largest in articles) or (where and 20 * sizes[k] > 19 * of_article[where]):
            continue
        if (3 * sizes[k] < total) if kind == "hinted" else (marked or 3 * sizes[k] < 2 * total):
            out.add(k)
    return out


def blocks(html: str) -> list[tuple[tuple[bool, int, int], str]]:
    """Blocks in page order with where they stand: whether in main, the number of the outermost
    article around them, from 1, else 0, and how many of their characters stand in links.

    One pass over the page: a tag ends at the first > outside of quotes. If there is none up to the
    end of the page, quotes don't count from there on; without any > the rest is text. Doubtful elements
    are judged when all of the page is known."""
    pieces: list[tuple[bool, int, str, int, bool, tuple[int, ...]]] = []  # with whether in a link
    ends: list[int] = []  # of blocks, as numbers of pieces
    doubts: list[tuple[str, int, list, set[int]]] = []  # kind, article around it, what it holds of main and articles
    stack: list[tuple[str, bool, bool, int, tuple[int, ...]]] = []  # name, left out, in main, article, doubts
    opened: Counter[str] = Counter()
    at, skipped, in_main, article, articles, around = 0, False, False, 0, 0, ()
    tag = TAG

    while True:
        found = MARKUP.search(html, at)
        m, stop = None, found.start() if found else len(html)
        if found and found[0][1] not in "!?":
            m = tag.match(html, stop)
            if m is None and tag is TAG:
                tag = BLIND_TAG
                m = tag.match(html, stop)
            if m is None:
                found, stop = None, len(html)
        if not skipped and stop > at:
            text = html[at:stop]
            pieces.append((in_main, article, text, sum(map(len, text.split())), opened["a"] > 0, around))
        if not found:
            ends.append(len(pieces))
            return _settled(pieces, ends, _left_out(pieces, doubts))
        if m is None:
            at = _after(html, {"<!--": "-->", "<![CDATA[": "]]>"}.get(found[0], ">"), found.end())
            continue
        at = m.end()
        name = m[2].lower()
        if name in BLOCKS and not skipped:
            ends.append(len(pieces))
        if m[1]:
            if opened[name]:
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
        else:
            if name in RAW:
                close = _closing(name).search(html, at)
                at = _after(html, ">", close.end()) if close else len(html)
                continue
            if name in VOID or m[3].endswith("/"):
                continue
            if stack and ((name in SIBLINGS and stack[-1][0] in SIBLINGS[name]) or (name in CLOSES_P and stack[-1][0] == "p")):
                opened[stack.pop()[0]] -= 1
            _, left_out, main, inner, around = stack[-1] if stack else ("", False, False, 0, ())
            kind = "out" if left_out else _doubt(name, m[3], main or inner > 0 or name == "article")
            if kind not in ("", "out") and len(around) < MOST_DOUBTS:
                around = (*around, len(doubts))
                doubts.append((kind, inner, [], set()))
            if name == "article" and not inner:
                articles += 1
                inner = articles
                for k in around:
                    doubts[k][3].add(inner)
            if name == "main" or ("role" in m[3].lower() and any(k.lower() == "role" and v.strip("\"'").lower() == "main" for k, v in ATTRIBUTE.findall(m[3]))):
                main = True
                if kind != "out":
                    for k in around:
                        doubts[k][2].append(True)
            stack.append((name, kind == "out", main, inner, around))
            opened[name] += 1
        _, skipped, in_main, article, around = stack[-1] if stack else ("", False, False, 0, ())


def _settled(pieces: list, ends: list[int], gone: set[int]) -> list[tuple[tuple[bool, int, int], str]]:
    out, first = [], 0
    for end in ends:
        own = [p for p in pieces[first:end] if gone.isdisjoint(p[5])] if gone else pieces[first:end]
        first = end
        text = " ".join(_decoded("".join(p[2] for p in own)).split())
        if text:
            out.append(((own[0][0], own[0][1], min(sum(len(p[2]) for p in own if p[4]), len(text))), text))
    return out


def split(html: str) -> tuple[list[str] | None, list[str]]:
    """Blocks that the page marks as its main text, or None if it marks none or a small part
    only, and all other blocks."""
    found = blocks(html)
    chars, links = Counter(), Counter()
    total = in_main = both = 0
    for (main, article, linked), b in found:
        total += len(b)
        in_main += len(b) * main
        both += len(b) if main or article else 0
        if article:
            chars[article] += len(b)
            links[article] += linked
    largest = max(chars, key=chars.get) if chars else 0
    # cards that lead to other articles: nearly all of their text is a link
    cards = {k for k, n in chars.items() if k != largest and links[k] >= 0.8 * n}
    if chars and 2 * (chars[largest] if in_main else both) >= (both if in_main else total):
        keep = lambda main, article: article > 0 and article not in cards
    elif in_main:
        keep = lambda main, article: article not in cards and (main or (article > 0 and 2 * in_main < both))
    else:
        return None, [b for _, b in found]
    return [b for p, b in found if keep(*p[:2])], [b for p, b in found if not keep(*p[:2])]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, int, list[str]]]:
    """Name, host, page, blocks of the streams of each page (host, page, html): OUTSIDE and INSIDE of marked
    main text, which never share an anchor."""
    for batch in batches:
        for c in range(0, batch.num_rows, 500):
            part = batch.slice(c, 500)
            for host, page, html in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                main, rest = split(html) if html else ([], [])
                if rest:
                    yield OUTSIDE, OUTSIDE + host, page, rest
                if main:
                    yield INSIDE, INSIDE + host, page, main


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, int, list[str]]]:
    for batch in batches:
        for host, page, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield host, host, page, found


def _tokens(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the blocks of a page, and the block of each."""
    raw = [b.encode() for b in found]
    off = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    start, end, first = t.words(data, off)
    return t.word_hashes(data, start, end) if len(data) else np.zeros(0, U), np.repeat(np.arange(len(raw)), np.diff(first))


class _Segments:
    """Segments of some streams: stream (its number), anchor (with its host), string, first token and end of
    the windows of each. ``token``: of all streams, which begin at ``base``."""

    def __init__(self, streams: list[tuple[str, str, int, list[str]]]):
        self.token, block = _tokens([b for s in streams for b in s[3]])
        self.base = np.searchsorted(block, np.r_[0, np.cumsum([len(s[3]) for s in streams])])
        token, n = self.token, len(self.token)
        if n < RUN:
            self.stream = self.start = self.end = np.zeros(0, np.int64)
            self.anchor = self.string = np.zeros(0, U)
            return
        piece = token[: n - PIECE + 1].copy()
        for k in range(1, PIECE):
            piece = piece * U(0xD1342543DE82EF95) + token[k : n - PIECE + 1 + k]
        low = np.lib.stride_tricks.sliding_window_view(t.mix(piece), RUN - PIECE + 1).min(1)
        of = np.repeat(np.arange(len(streams)), np.diff(self.base))[: len(low)]
        beyond = self.base[of + 1] - RUN + 1  # windows do not cross streams
        new = np.r_[True, (low[1:] != low[:-1]) | (of[1:] != of[:-1])] & (np.arange(len(low)) < beyond)
        self.start = np.flatnonzero(new)
        self.stream = of[self.start]
        self.end = np.minimum(np.r_[self.start[1:], len(low)], beyond[self.start])
        # sums of mixed tokens times 1, 3, 5, .. from the start of the segment
        mixed = t.mix(token)
        plain = np.r_[U(0), np.cumsum(mixed)]
        weighted = np.r_[U(0), np.cumsum(mixed * (2 * np.arange(n, dtype=U) + U(1)))]
        last = self.end + RUN - 1
        self.string = t.mix(weighted[last] - weighted[self.start] - U(2) * self.start.astype(U) * (plain[last] - plain[self.start]))
        host = {h: hash_of(h) for h in {s[1] for s in streams}}
        self.anchor = t.mix(low[self.start] + np.array([host[s[1]] for s in streams], U)[self.stream])


def _together(streams: Iterator[tuple[str, str, int, list[str]]]) -> Iterator[list[tuple[str, str, int, list[str]]]]:
    """Streams in lists of about a million characters."""
    held, size = [], 0
    for s in streams:
        held.append(s)
        size += sum(map(len, s[3]))
        if size >= 1 << 20:
            yield held
            held, size = [], 0
    if held:
        yield held


def _packed(words: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    """Words in BUCKETS by the first bits of their hashes."""
    order = np.argsort(of >> U(64 - BITS), kind="stable")
    bucket = (of >> U(64 - BITS))[order].astype(np.int32)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    parts = np.split(words[order], first[1:])
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([x.tobytes() for x in parts], pa.binary())], ["bucket", "words"])


def _anchor_words(read: Callable) -> Callable:
    """An anchor and its string as a word, once for a stream."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for streams in _together(read(batches)):
            g = _Segments(streams)
            order = np.lexsort((g.string, g.anchor, g.stream))
            own = np.stack([g.stream.astype(U), g.anchor, g.string])[:, order]
            held.append(own[1:, np.r_[True, (own[:, 1:] != own[:, :-1]).any(0)][: own.shape[1]]])
            size += held[-1].shape[1]
            if size >= PACKED:
                yield _packed(*_words_of(held))
                held, size = [], 0
        if size:
            yield _packed(*_words_of(held))

    return words


def _words_of(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    anchor, string = np.concatenate(held, 1)
    return (anchor << U(36)) | (string >> U(28)), anchor


def _page_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            page = batch.column(0).to_numpy().view(U)
            yield _packed(page << U(36), page)


class Marks:
    """Which hashes were met: bits for each bucket, in two tables."""

    def __init__(self, rows: list):
        self.at = np.zeros((2, 1 << BITS), np.int64)
        self.mask = np.zeros((2, 1 << BITS), np.int64)
        parts, size = [np.zeros(1, np.uint8)], 1  # a bucket without bits: the first
        for r in rows:
            for k, x in enumerate((r["met"], r["differ"])):
                if x:
                    self.at[k, r["bucket"]], self.mask[k, r["bucket"]] = size, 8 * len(x) - 1
                    parts.append(np.frombuffer(x, np.uint8))
                    size += len(x)
        self.bits = np.concatenate(parts)

    def of(self, hashes: np.ndarray, table: int = 0) -> np.ndarray:
        bucket = (hashes >> U(64 - BITS)).astype(np.int64)
        k = (hashes & U((1 << 28) - 1)).astype(np.int64) & self.mask[table, bucket]
        return (self.bits[self.at[table, bucket] + (k >> 3)] >> (k & 7).astype(np.uint8)) & 1 > 0


def _bits(keys: np.ndarray) -> bytes:
    """A table of bits with at least 64 for each key, up to MOST_BITS."""
    if not len(keys):
        return b""
    size = min(MOST_BITS, 1 << int(64 * len(keys) - 1).bit_length())
    table = np.zeros(size, bool)
    table[keys.astype(np.int64) & (size - 1)] = True
    return np.packbits(table, bitorder="little").tobytes()


def marks(packed: DataFrame, least: int) -> Marks:
    """Hashes that ``least`` words have, and those that different words have; at most 2 * MOST_BITS
    bits a bucket, more hashes only make them denser."""

    def bucket(table: pa.Table) -> pa.Table:
        word = np.sort(np.concatenate([np.frombuffer(x, U) for x in table.column("words").to_pylist()]))
        key = word >> U(36)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "met": pa.array([_bits(key[first[size >= least]])], pa.binary()), "differ": pa.array([_bits(key[first[word[first] != word[first + size - 1]]])], pa.binary())})

    # written, so that Spark drops the shuffle when it is made
    return Marks(written(packed.groupBy("bucket").applyInArrow(bucket, "bucket int, met binary, differ binary"), "marks").collect())


SEGMENT = "host string, page long, anchor long, string long, place int, windows int, differ boolean, tokens binary"


def _segments(read: Callable, known) -> Callable:
    """Name (as host), page, anchor, string, place, windows of segments whose anchor repeats; whether its strings
    differ, and then tokens, once for MOST_SEEN strings of a task."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for streams in _together(read(batches)):
            g = _Segments(streams)
            kept = np.flatnonzero(known.value.of(g.anchor))
            of, start, end = g.stream[kept], g.start[kept], g.end[kept]
            differ = known.value.of(g.anchor[kept], 1)
            tokens: list[bytes | None] = [None] * len(kept)
            for k in np.flatnonzero(differ).tolist():
                key = int(g.string[kept[k]] ^ g.anchor[kept[k]])
                if key not in seen:
                    seen.add(key)
                    tokens[k] = g.token[start[k] : end[k] + RUN - 1].tobytes()
            if len(seen) > MOST_SEEN:
                seen.clear()
            name, page = pa.array([s[0] for s in streams], pa.string()), pa.array([s[2] for s in streams], pa.int64())
            at, place = pa.array(of), (start - g.base[of]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([name.take(at), page.take(at), pa.array(g.anchor[kept].view(np.int64)), pa.array(g.string[kept].view(np.int64)), pa.array(place), pa.array((end - start).astype(np.int32)), pa.array(differ), pa.array(tokens, pa.binary())], ["host", "page", "anchor", "string", "place", "windows", "differ", "tokens"])

    return segments


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings (anchor, string, windows, tokens) of hot anchors as their windows, by place."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            token = np.frombuffer(r["tokens"], U)
            for k in range(r["windows"]):
                text = token[k : k + RUN]
                h = int(t.mix((t.mix(text) * (2 * np.arange(RUN, dtype=U) + U(1))).sum(keepdims=True)).view(np.int64)[0])
                out.append({"anchor": r["anchor"], "string": r["string"], "skip": k, "window": h, "text": text.tobytes()})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("anchor", pa.int64()), ("string", pa.int64()), ("skip", pa.int32()), ("window", pa.int64()), ("text", pa.binary())]))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols at least, by doubling. ``text``:
    numbers from 1, 0 as the mark between strings."""
    rank, width, n = text.astype(U), 1, len(text)
    while True:
        key = rank << U(32)
        if n > width:
            key[: n - width] |= rank[width:]
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, U)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]]).astype(U) + U(1)
        width *= 2
        if width >= depth:
            return order


def shared_runs(strings: list[np.ndarray], windows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of RUN tokens that stand on distinct pages: string, first window, windows.
    low and high: smallest and largest page of each string."""
    size = np.array([len(s) for s in strings])
    base = np.cumsum(size + 1) - (size + 1)
    kinds, code = np.unique(np.concatenate(strings), return_inverse=True)
    text = np.zeros(int(base[-1] + size[-1] + 1), np.int64)
    inside = np.ones(len(text), bool)
    inside[base + size] = False
    text[inside] = code + 1
    order = suffix_array(text, RUN)
    padded = np.r_[text, np.full(RUN, -1)]
    same = np.ones(len(order), bool)
    same[0] = False
    for k in range(RUN):
        same[1:] &= padded[order[1:] + k] == padded[order[:-1] + k]
    group = np.cumsum(~same) - 1
    string = np.repeat(np.arange(len(strings)), windows)
    nth = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    of = np.full(len(text), -1, np.int64)
    of[base[string] + nth] = np.arange(len(string))
    row = of[order]
    group, row = group[row >= 0], row[row >= 0]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    distinct = np.minimum.reduceat(low[string[row]], starts) != np.maximum.reduceat(high[string[row]], starts)
    hit = np.zeros(len(string), bool)
    hit[row] = np.repeat(distinct, np.diff(np.r_[starts, len(row)]))
    string, nth = string[hit], nth[hit]
    at = np.flatnonzero(np.r_[True, (string[1:] != string[:-1]) | (nth[1:] != nth[:-1] + 1)]) if len(nth) else np.zeros(0, np.int64)
    return string[at], nth[at], np.diff(np.r_[at, len(nth)])


def _array_of_unit(table: pa.Table) -> Iterator[pa.RecordBatch]:
    # symbols of different hosts must differ, so anchors, which hold the host, are mixed in
    anchors = table.column("anchor").to_numpy().view(U)
    strings = [np.frombuffer(x, U) ^ a for x, a in zip(table.column("tokens").to_pylist(), anchors, strict=True)]
    string, first, n = shared_runs(strings, table.column("windows").to_numpy().astype(np.int64), table.column("low").to_numpy(), table.column("high").to_numpy())
    at = pa.array(string)
    yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks().take(at) for c in ("anchor", "string")], pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "string", "skip", "n"])


def hash_of(text: str) -> np.uint64:
    data = np.frombuffer(b"\1" + text.encode(), np.uint8)
    return t.word_hashes(data, np.zeros(1, np.int64), np.full(1, len(data)))[0]


def _without(found: list[str], spans: list[dict]) -> list[str]:
    _, block = _tokens(found)
    gone = _covered(spans, len(block))
    words, at = [], 0
    for k, b in enumerate(found):
        n = int((block == k).sum())
        words.append(" ".join(w for w, g in zip(b.split(" "), gone[at : at + n], strict=False) if not g))
        at += n
    return [w for w in words if w]


def _covered(spans: list[dict], n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[s["begin"]] += 1
        edge[s["finish"]] -= 1
    return np.cumsum(edge)[:-1] > 0


TEXTS = "page_id long, url string, text string, n_chars long, n_shared long"


def _checked(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Texts of pages (page_id, url, html, spans outside of marked main text, words shared inside): what the array
    proposes goes from a page without marks, and is counted in marked main text."""
    while held := list(islice(rows, 500)):
        texts, shared = [], []
        for _, _, html, outside, inside in held:
            main, rest = split(html) if html else ([], [])
            if main is None:
                main, n = _without(rest, outside) if outside else rest, 0
            else:
                n = inside or 0
            texts.append("\n".join(main))
            shared.append(n)
        columns = [pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(shared, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "n_shared"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for c in range(0, batch.num_rows, 500):
            yield from zip(*(x.to_pylist() for x in batch.slice(c, 500).columns), strict=True)


def _unshared(known) -> Callable:
    """Texts of pages without proposals."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (b.filter(pa.array(~known.value.of(b.column(0).to_numpy().view(U)))) for b in batches)
        return _checked((page_id, url, html, None, None) for _, page_id, url, html in _rows(own))

    return texts


def _maybe_shared(known) -> Callable:
    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(known.value.of(b.column(0).to_numpy().view(U))))

    return pages


def _merged(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """host, page, spans from host, page, begin, n of whole pages in order."""
    out: list[tuple[str, int, list[dict]]] = []
    for host, page, begin, n in zip(*(table.column(c).to_pylist() for c in ("host", "page", "begin", "n")), strict=True):
        if not out or (host, page) != out[-1][:2]:
            out.append((host, page, []))
        own = out[-1][2]
        if own and begin <= own[-1]["finish"]:
            own[-1]["finish"] = max(own[-1]["finish"], begin + n + RUN - 1)
        else:
            own.append({"begin": begin, "finish": begin + n + RUN - 1})
    host, page, spans = zip(*out, strict=True)
    span = pa.list_(pa.struct([("begin", pa.int64()), ("finish", pa.int64())]))
    yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(spans, span)], ["host", "page", "spans"])


def host_spans(pages: DataFrame, read: Callable = _given) -> DataFrame:
    """host, page, spans (begin, finish in tokens of the page) that distinct pages share, from
    (host, page, blocks), or what ``read`` makes streams of."""
    spark = pages.sparkSession
    known = spark.sparkContext.broadcast(marks(pages.mapInArrow(_anchor_words(read), "bucket int, words binary"), 2))
    segments = written(pages.mapInArrow(_segments(read, known), SEGMENT), "segments")
    keys = ["anchor", "string"]
    ends = segments.groupBy(*keys).agg(F.min("page").alias("low"), F.max("page").alias("high"), F.first("windows").alias("windows"), F.first("differ").alias("differ"))
    texts = segments.where("tokens is not null").groupBy(*keys).agg(F.first("tokens").alias("tokens"))
    strings = written(ends.where("differ or low <> high").join(texts, keys, "left"), "strings")
    whole = strings.where("not differ").select(*keys, F.lit(0).alias("skip"), F.col("windows").alias("n"))
    strings = strings.where("differ").drop("differ")
    hot = written(strings.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot")  # known to be small
    arrays = strings.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    runs = arrays.mapInArrow(by_runs("anchor", _array_of_unit), "anchor long, string long, skip int, n int")
    single = strings.join(hot, "anchor", "left_semi")
    windows = single.select(*keys, "windows", "tokens").mapInArrow(_single_windows, "anchor long, string long, skip int, window long, text binary").join(single.select(*keys, "low", "high"), keys)
    alike = windows.groupBy("anchor", "window", "text").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    hot_runs = windows.select(*keys, "skip", "window", "text").join(alike.drop("low", "high"), ["anchor", "window", "text"]).select(*keys, "skip", F.lit(1).alias("n"))
    hits = segments.select("host", *keys, "page", "place").join(whole.unionByName(runs).unionByName(hot_runs), keys)
    hits = hits.select("host", "page", (F.col("place") + F.col("skip")).alias("begin"), "n")
    return hits.repartition("page").sortWithinPartitions("page", "host", "begin").mapInArrow(by_runs("page", _merged), "host string, page long, spans array<struct<begin: long, finish: long>>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_shared (words of the text in runs that other pages of the host have
    in their main text, too) for each row of ``pages`` (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"), host.alias("host"))
    source = source.withColumn("page", F.xxhash64("page_id", "html", "host"))
    spans = host_spans(source.select("host", "page", "html"), _streams)
    is_inside = F.col("host") == INSIDE
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["finish"] - x["begin"])
    proposed = written(spans.groupBy("page").agg(F.first(F.when(~is_inside, F.col("spans")), True).alias("outside"), F.max(F.when(is_inside, words)).alias("inside")), "proposed")
    known = pages.sparkSession.sparkContext.broadcast(marks(proposed.select("page").mapInArrow(_page_words, "bucket int, words binary"), 1))
    source = source.select("page", "page_id", "url", "html")
    # only pages that may have proposals move to meet them
    shared = source.mapInArrow(_maybe_shared(known), source.schema).join(proposed, "page", "left").drop("page")
    return source.mapInArrow(_unshared(known), TEXTS).unionByName(shared.mapInArrow(lambda batches: _checked(_rows(batches)), TEXTS))
