"""Removal of repeated strings of ``size`` bytes by threshold-bounded interval expansion on a BWT.

A byte goes if a string of ``size`` bytes that covers it also starts earlier (smaller id, or same
document and smaller place). Strings are compared by an index over the bytes: suffixes are sorted,
the Burrows-Wheeler transform is taken, and intervals of equal prefixes grow by one byte to the
left per level, breadth first. Level by level this fixes the places where neighbouring suffixes
share 0, 1, 2, ... bytes; it ends at ``size``. Places not fixed by then part nothing: the suffixes
between two fixed places share ``size`` bytes, and the earliest of them stays.

To spread the index over tasks, every string of ``size`` bytes (window) belongs to its anchor, the
smallest hash among its pieces of PIECE bytes, which equal windows have in common. Successive
windows with one anchor form a segment. Anchors are counted first, with counts combined before the
shuffle, and segments whose piece stands in one place of the corpus only are dropped in a join.
Equal segments are one string with an earliest place; all later places lose all windows. This, and how
many strings an anchor has, is settled by windows in order of (anchor, string, place), where the join
has put the segments, so that they move once. Strings go into the index at their earliest place, but for one that
has its anchor to itself and once only, as no other window can equal one of its own; the strings of an
anchor always meet in one index, with those of many other anchors. A block of texts sends each string
once, so a hot passage brings few rows, and windows spill. Where one anchor has over HOT
different strings, as the edges of a passage that very many documents quote, they are cut into
single windows, which meet by what they are, and the earliest of equal ones stays. Both come from one pass over
the texts. Nothing is capped. All joins are merge joins: lists of segments and spans grow with the
corpus and are never broadcast.

Defined results: a null text has no bytes; texts shorter than ``size`` lose nothing; documents of
equal id are not earlier than each other at the same place; a null id counts as smaller than all
others; repeated rows are judged alike and get equal results. Rows are told apart by id and 64 bits
of the text, without id by 128 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textnum as t
from tessera.llm.shared import by_runs, run_starts
from tessera.operators.tables import written

U = np.uint64
PIECE = 20
SEND_BYTES = 2 << 20  # of text whose equal segments are sent once
MOST_WINDOWS = 256  # of a segment; longer runs, as in text of one repeated word, are cut
HOT = 2000
INDEX_ROWS = 4_000  # strings that are read before indexes are made of them
INDEX_BYTES = 250_000  # of an index; the strings of an anchor, up to HOT, come on top


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the PIECE bytes from each place, by doubling; the last PIECE - 1 mean nothing."""
    h, width, parts = t.BYTE[data], 1, []
    for bit in range(PIECE.bit_length()):
        if PIECE >> bit & 1:
            parts.append((width, h))
        if width * 2 <= PIECE:
            nxt = h * U(0x9E3779B97F4A7C15 + 2 * bit)
            nxt[: len(h) - width] += h[width:]
            nxt ^= nxt >> U(29)
            h, width = nxt, width * 2
    at, acc = 0, np.zeros(len(data), U)
    for width, h in parts:
        acc = acc * U(0xD1342543DE82EF95)
        acc[: len(data) - at] += h[at:] if at else h
        at += width
    return t.mix(acc)


IDENTITY = ["_id", "_none", "version"]
SEGMENT = "_id long, _none boolean, version long, anchor long, string long, place long, windows int, again boolean, later boolean"
STRING = "_id long, _none boolean, version long, anchor long, string long, place long, windows int, bytes binary, unit long"
SPAN = "_id long, _none boolean, version long, begin long, finish long"


def _again(hashes: np.ndarray, start: np.ndarray, length: np.ndarray, anchor: np.ndarray, reach: int) -> np.ndarray:
    """Whether the piece of the anchor stands more than once in a segment: its first place in
    the first window is not that in the last, or the last window has it twice."""
    view = np.lib.stride_tricks.sliding_window_view(hashes, reach)
    out = np.zeros(len(start), bool)
    for c in range(0, len(start), 10_000):
        at = slice(c, c + 10_000)
        end = start[at] + length[at] - 1
        equal = view[end] == anchor[at, None]
        out[at] = (start[at] + view[start[at]].argmin(1) != end + equal.argmax(1)) | (equal.sum(1) > 1)
    return out


def anchors(data: np.ndarray, off: np.ndarray, size: int, again: bool = False) -> tuple[np.ndarray, ...]:
    """Segments of all rows: row, place in the row, number of windows, anchor; and if asked,
    whether the anchor stands in the segment again."""
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none, none, none, none.astype(bool)
    hashes = low = piece_hashes(data)[: len(data) - PIECE + 1]
    wide, reach = 1, size - PIECE + 1
    while wide * 2 <= reach:
        low, wide = np.minimum(low[:-wide], low[wide:]), wide * 2
    if wide < reach:
        low = np.minimum(low[: wide - reach], low[reach - wide :])
    n = np.maximum(np.diff(off) - size + 1, 0)  # windows of each row
    has = np.flatnonzero(n)
    if not len(has):
        return none, none, none, none, none.astype(bool)
    inside = np.zeros(len(low) + 1, np.int32)
    inside[off[has]] += 1
    inside[np.minimum(off[has] + n[has], len(low))] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    new = np.r_[True, (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])]
    new[off[has]] = True
    start = np.flatnonzero(new)
    length = np.diff(np.r_[start, len(low)])
    start, length = start[inside[start]], length[inside[start]]
    repeats = _again(hashes, start, length, low[start], size - PIECE + 1) if again else np.zeros(len(start), bool)
    cut = -(-length // MOST_WINDOWS)
    if (cut > 1).any():
        nth = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
        repeats = np.repeat(repeats, cut)
        start, length = np.repeat(start, cut) + nth * MOST_WINDOWS, np.repeat(length, cut) - nth * MOST_WINDOWS
        length = np.minimum(length, MOST_WINDOWS)
    row = np.searchsorted(off, start, "right") - 1
    return row, start - off[row], length, low[start].view(np.int64), repeats


def _copies(ids: np.ndarray, none: np.ndarray, version: np.ndarray) -> np.ndarray:
    """Whether a row is the same as one before it."""
    order = np.lexsort((version, ids, none))
    same = np.r_[False, (ids[order][1:] == ids[order][:-1]) & (none[order][1:] == none[order][:-1]) & (version[order][1:] == version[order][:-1])]
    out = np.zeros(len(ids), bool)
    out[order] = same
    return out


def _anchors(size: int):
    """The distinct anchors of each block of texts, and whether the block, without repeated rows,
    has the piece in several places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            identity = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            for i, j, data, off in t.column_blocks(batch.column(3), SEND_BYTES):
                row, _, _, anchor, again = anchors(data, off, size, again=True)
                single = ~_copies(*(x[i:j] for x in identity))[row]
                turn = np.argsort(anchor[single], kind="stable")
                anchor, again = anchor[single][turn], again[single][turn]
                start = run_starts(anchor)
                if len(start) > 1:
                    several = (np.diff(start) > 1) | (np.add.reduceat(again.astype(np.int64), start[:-1]) > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[start[:-1]]), pa.array(several)], ["anchor", "several"])

    return run


def _segments(size: int):
    """Rows of SEGMENT from (_id, _none, version, text). string: hash of the segment; again: the
    segment has the anchor's piece in several places; later: the block has the string earlier, so its windows go; the anchor of such a row is a number of its own, which
    spreads what one passage sends. A row repeated in a block is sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, none, version = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for i, j, data, off in t.column_blocks(batch.column(3), SEND_BYTES):
                row, place, length, anchor, again = anchors(data, off, size, again=True)
                single = ~_copies(ids[i:j], none[i:j], version[i:j])[row]
                row, place, length, anchor, again = (x[single] for x in (row, place, length, anchor, again))
                if not len(row):
                    continue
                start = off[row] + place
                string = t.string_hashes(data, start, start + length + size - 1).view(np.int64)
                # earliest first within the block: null ids, then by id, then by place
                doc = np.where(none[i:j], 0, ids[i:j])
                rank = np.empty(j - i, np.int64)
                rank[np.lexsort((doc, ~none[i:j]))] = np.arange(j - i)
                turn = np.lexsort((place, rank[row], string, anchor))
                row, place, length, anchor, string, again = (x[turn] for x in (row, place, length, anchor, string, again))
                new = np.r_[True, anchor[1:] != anchor[:-1]]
                first = np.r_[True, new[1:] | (string[1:] != string[:-1])]
                of = np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))  # the earliest of equal ones
                later = (doc[row] != doc[row][of]) | (none[i:j][row] != none[i:j][row][of]) | (place != place[of])
                own = t.mix(anchor.view(U) + place.astype(U) * U(0x9E3779B97F4A7C15) + (ids[i:j][row] ^ version[i:j][row]).view(U) * U(0xD1342543DE82EF95)).view(np.int64)
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(3)], pa.array(np.where(later, own, anchor)), pa.array(string), pa.array(place), pa.array(length.astype(np.int32)), pa.array(again), pa.array(later)], [*IDENTITY, "anchor", "string", "place", "windows", "again", "later"])

    return run


def _strings(size: int):
    """The segments of each document's list with their bytes, or, of hot anchors, their windows. unit: where
    they meet, those of an anchor, or equal windows. Rows come in order of identity; of rows that are the same
    only the first is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None] * 3
        for batch in batches:
            listed = batch.column(4)
            of, flat = listed.offsets.to_numpy(), listed.values
            flat = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
            identity = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            fresh_row = np.zeros(batch.num_rows, bool)
            for x, before in zip(identity, last, strict=True):
                fresh_row |= np.r_[before is None or x[0] != before, x[1:] != x[:-1]] if len(x) else False
            last = [x[-1] for x in identity] if batch.num_rows else last
            for i, j, data, off in t.column_blocks(batch.column(3)):
                own = np.repeat(fresh_row[i:j], np.diff(of[i : j + 1]))
                rows = np.repeat(np.arange(j - i), np.diff(of[i : j + 1]))[own]
                listed_here = [flat[c][of[i] : of[j]][own] for c in ("anchor", "string", "place", "windows")]
                hot, whole = flat["hot"][of[i] : of[j]][own].astype(bool), data.tobytes()
                for single in (False, True):
                    row, anchor, string, place, windows = (x[hot == single] for x in (rows, *listed_here))
                    if single:
                        nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                        row, anchor, place, windows = np.repeat(row, windows), np.repeat(anchor, windows), np.repeat(place, windows) + nth, np.ones(windows.sum(), np.int32)
                    start = off[row] + place
                    end = start + windows + size - 1
                    unit = anchor
                    if single:
                        string = t.string_hashes(data, start, end).view(np.int64)
                        unit = t.mix(anchor.view(U) + string.view(U) * U(0xD1342543DE82EF95)).view(np.int64)
                    for c in range(0, len(row), 20_000):
                        part = slice(c, c + 20_000)
                        at = pa.array(row[part] + i)
                        texts = pa.nulls(len(at), pa.binary()) if single else pa.array([whole[a:b] for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)], pa.binary())
                        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(3)], pa.array(anchor[part]), pa.array(string[part]), pa.array(place[part]), pa.array(windows[part].astype(np.int32)), texts, pa.array(unit[part])], [*IDENTITY, "anchor", "string", "place", "windows", "bytes", "unit"])

    return run


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes sorted by their first 100 symbols at least, by doubling; beyond, and at equal
    ones, any order will do. ``text``: bytes plus 1, 0 as the mark between strings. Ranks and
    places are packed in one number each, so that numbers and not references are sorted."""
    n = len(text)
    bits = max(9, n.bit_length())
    if 3 * bits > 64:
        raise ValueError("an index holds up to 2 million symbols")
    low, shift = U((1 << bits) - 1), U(bits)
    width = 2 * bits // 9
    padded = np.r_[text.astype(U), np.zeros(width, U)]
    key = np.zeros(n, U)
    for i in range(width):
        key = (key << U(9)) | padded[i : i + n]
    here = np.arange(n, dtype=U)
    while True:
        packed = np.sort((key << shift) | here)
        order = (packed & low).astype(np.int64)
        if width >= 100:
            return order
        packed >>= shift
        rank = np.empty(n, U)
        rank[order] = np.cumsum(np.r_[True, packed[1:] != packed[:-1]]).astype(U)
        key = rank << shift
        if n > width:
            key[: n - width] |= rank[width:]
        width *= 2


def shared_prefix_classes(text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it the number of its class: suffixes of one class share
    their first ``size`` symbols. ``text`` ends with a 0; other 0s stand between strings.

    Holds the intervals of the prefixes of the present length. The interval of a prefix grown by a
    symbol c to its left runs from where the mapping from last to first column takes the first c
    of the interval to where it takes the last. If nothing is known at its right end yet, the
    suffixes that meet there share exactly the length before growth, and the interval goes on."""
    n = len(text)
    bits = U(n.bit_length())
    low = (U(1) << bits) - U(1)
    order = suffix_order(text)
    last = text[order - 1]  # for the suffix at 0 this is the closing mark
    to_first = np.empty(n, np.int64)
    to_first[np.argsort(last, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    left, right = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for length in range(size):
        width = right - left
        single = width == 1
        one = left[single]
        if length:
            one = one[last[one] != 0]
        new_left = [to_first[one]]
        new_right = [new_left[0] + 1]
        if len(one) < len(left) and not single.all():
            a, w = left[~single], width[~single]
            which = np.repeat(np.arange(len(a)), w)
            row = np.arange(len(which)) + np.repeat(a - (np.cumsum(w) - w), w)
            symbol = last[row]
            if length:
                keep = symbol != 0
                which, row, symbol = which[keep], row[keep], symbol[keep]
            if len(row):
                packed = np.sort((((which.astype(U) << U(9)) | symbol.astype(U)) << bits) | row.astype(U))
                group, row = packed >> bits, (packed & low).astype(np.int64)
                change = group[1:] != group[:-1]
                new_left.append(to_first[row[np.r_[True, change]]])
                new_right.append(to_first[row[np.r_[change, True]]] + 1)
        left, right = np.concatenate(new_left), np.concatenate(new_right)
        fresh = ~known[right]
        left, right = left[fresh], right[fresh]
        if not len(left):
            break
        known[right] = True
    return order, np.cumsum(known[:n]) - 1


def earliest(strings: list[bytes], windows: np.ndarray, doc: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """For each string, whose earliest place is in document number ``doc`` at ``place``, runs of
    its windows and the earliest place of equal windows: string, first window, windows, document
    number, place."""
    length = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
    base = np.cumsum(length + 1) - (length + 1)
    text = data.astype(np.uint16) + np.uint16(1)
    text[base + length] = 0
    order, group = shared_prefix_classes(text, size)
    of = np.full(len(text), -1, np.int64)
    window_string = np.repeat(np.arange(len(strings)), windows)
    nth = np.arange(len(window_string)) - np.repeat(np.cumsum(windows) - windows, windows)
    of[base[window_string] + nth] = np.arange(len(window_string))
    row = of[order]
    group, row = group[row >= 0], row[row >= 0]
    key = (doc[window_string].astype(np.int64) << np.int64(36)) + place[window_string] + nth
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.minimum.reduceat(key[row], starts)
    first = np.empty(len(row), np.int64)
    first[row] = np.repeat(least, np.diff(np.r_[starts, len(row)]))
    new = np.r_[True, (first[1:] != first[:-1] + 1) | (window_string[1:] != window_string[:-1])]
    at = np.flatnonzero(new)
    return window_string[at], nth[at], np.diff(np.r_[at, len(first)]), first[at] >> np.int64(36), first[at] & np.int64((1 << 36) - 1)


def _index(size: int):
    """Spans that strings, and single windows, which have no bytes, lose at their earliest place."""

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        single = table.column("bytes").is_null()
        if pc.any(single).as_py():
            yield windows_of(table.filter(single))
            table = table.filter(pc.invert(single))
        starts = run_starts(table.column("anchor").to_numpy())
        upto = np.r_[0, np.cumsum(table.column("windows").to_numpy() + size)][starts]
        a = 0
        while a < len(starts) - 1:
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + INDEX_BYTES, "right")) - 1)
            yield one(table.slice(starts[a], starts[b] - starts[a]))
            a = b

    def windows_of(table: pa.Table) -> pa.RecordBatch:
        ids, none, anchor, string, place = (table.column(c).to_numpy() for c in ("_id", "_none", "anchor", "string", "place"))
        doc = np.where(none, 0, ids)
        turn = np.lexsort((place, doc, ~none, string, anchor))
        none, anchor, string, place, doc = (x[turn] for x in (none, anchor, string, place, doc))
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (string[1:] != string[:-1])]
        of = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))  # the earliest of equal ones
        late = (doc != doc[of]) | (none != none[of]) | (place != place[of])
        at = pa.array(turn[late])
        return pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks().take(at) for c in (*IDENTITY, "anchor", "string")], pa.array(place[late]), pa.array(place[late] + size)], [*IDENTITY, "anchor", "string", "begin", "finish"])

    def one(table: pa.Table) -> pa.RecordBatch:
        known = ~table.column("_none").to_numpy(zero_copy_only=False)
        ids = table.column("_id").to_numpy()
        distinct = np.unique(ids[known])
        doc = np.where(known, np.searchsorted(distinct, ids) + 1, 0)  # null ids come first
        place = table.column("place").to_numpy()
        windows = table.column("windows").to_numpy().astype(np.int64)
        string, skip, n, first_doc, first_place = earliest(table.column("bytes").to_pylist(), windows, doc, place, size)
        begin = place[string] + skip
        later = (doc[string] > first_doc) | (begin > first_place)
        at = pa.array(string[later])
        return pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks().take(at) for c in (*IDENTITY, "anchor", "string")], pa.array(begin[later]), pa.array((begin + n + size - 1)[later])], [*IDENTITY, "anchor", "string", "begin", "finish"])

    return by_runs("unit", handle, rows=INDEX_ROWS)


def kept(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the spans, the number of bytes gone and of maximal runs gone."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]), sum(b - a for a, b in merged), len(merged)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            left, gone, runs = kept(data, [(s["begin"], s["finish"]) for s in spans.as_py() or ()])
            for o, v in zip(out, (len(data), gone, runs, hashlib.sha256(left).hexdigest()), strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(o, pa.int64()) for o in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def identified(docs: DataFrame) -> DataFrame:
    """(_id, _none, version, text): rows of one identity have equal id and text. Null ids, which
    may be very many, are told apart by 128 bits of the text."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.xxhash64(F.lit(1), "text")).alias("_id"), doc_id.isNull().alias("_none"), F.xxhash64("text").alias("version"), "text")


def repeated_spans(texts: DataFrame, size: int = 100) -> DataFrame:
    """For each identity in ``texts`` that loses bytes, the set of its spans (begin, finish), which
    may overlap."""
    rows = texts.mapInArrow(_segments(size), SEGMENT)
    counted = texts.mapInArrow(_anchors(size), "anchor long, several boolean").groupBy("anchor").agg(F.count("*").alias("n"), F.max("several").alias("several"))
    repeated = written(counted.where("n > 1 or several").select("anchor", F.lit(True).alias("hit")), "anchors")
    # of equal strings the earliest; of those that are equally early, any
    turn = F.struct((~F.col("_none")).alias("known"), F.when(F.col("_none"), 0).otherwise(F.col("_id")).alias("doc"), "place")
    anchored = Window.partitionBy("later", "anchor")
    ordered = Window.partitionBy("later", "anchor", "string").orderBy("turn", *IDENTITY)
    met = rows.join(repeated.hint("merge"), "anchor", "left").where("later or hit").withColumn("turn", turn)
    met = met.withColumn("chosen", F.row_number().over(ordered) == 1).withColumn("early", F.col("turn") == F.first("turn").over(ordered)).withColumn("tie", F.struct(*IDENTITY) != F.first(F.struct(*IDENTITY)).over(ordered))
    n = F.count_if("chosen").over(anchored)
    # the only string of an anchor whose piece it has once shares no window with anything
    met = met.withColumn("indexed", (n > 1) | F.max("again").over(anchored)).withColumn("hot", n > HOT)
    found = written(met.select(*IDENTITY, "anchor", "string", "place", "windows", (F.col("later") | ~F.col("early")).alias("lost"), "chosen", (F.col("early") & F.col("tie")).alias("tie"), "indexed", "hot").where("lost or indexed or tie"), "segments")
    end = (F.col("place") + F.col("windows") + size - 1).alias("finish")
    spans = found.where("lost").select(*IDENTITY, F.col("place").alias("begin"), end)

    kept_here = found.where("not lost and indexed and (chosen or (hot and tie))")
    listed = kept_here.groupBy(*IDENTITY).agg(F.collect_list(F.struct("anchor", "string", "place", "windows", "hot")).alias("segments"))
    full = texts.join(listed.hint("merge"), IDENTITY).select(*IDENTITY, "text", "segments").mapInArrow(_strings(size), STRING)
    lost = full.repartition("unit").sortWithinPartitions("unit").mapInArrow(_index(size), SPAN.replace("begin", "anchor long, string long, begin"))
    ties = found.where("not lost and indexed and tie and not hot").select(*IDENTITY, "anchor", "string")
    if not ties.isEmpty():
        lost = written(lost, "lost")
        spans = spans.unionByName(ties.join(lost.drop(*IDENTITY).hint("merge"), ["anchor", "string"]).drop("anchor", "string"))
    spans = spans.unionByName(lost.drop("anchor", "string"))
    return spans.groupBy(*IDENTITY).agg(F.collect_set(F.struct("begin", "finish")).alias("spans"))


def _cut(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text, spans of each row."""
    texts = identified(docs)
    full = texts.join(repeated_spans(texts, size).hint("merge"), IDENTITY, "left")
    return full.select(F.when(~F.col("_none"), F.col("_id")).alias("doc_id"), "text", "spans")


def dedup_digest(docs: DataFrame, size: int = 100) -> DataFrame:
    """The columns of op5."""
    return _cut(docs, size).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_documents(docs: DataFrame, size: int = 100) -> DataFrame:
    """doc_id and the remaining bytes of each text; a cut may fall within a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [kept(x.as_buffer().to_pybytes() if x.is_valid else b"", [(s["begin"], s["finish"]) for s in y.as_py() or ()])[0] for x, y in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.binary())], ["doc_id", "kept"])

    return _cut(docs, size).mapInArrow(run, "doc_id long, kept binary")
