"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label are one node with a multiplicity. Random projections give each node one
string of signs; a pass takes the next ``bits`` of them as the node's code. In each pass the nodes
are put in lexicographic order of (label, code) and every node is compared with those that follow
it, up to WINDOW - 1 of them and up to the end of the run of its code. Code length makes a run
about WINDOW / 2 long on evenly spread data; the number of passes is what the target recall at the
threshold takes. Runs longer than the window, as around a dense cluster, are cut into blocks of
BLOCK and every pair of blocks is compared: that is the exact way for what the window would miss,
and no task holds a run.

Only the signs move in the passes. Two nodes are a candidate pair in the first pass whose code they
share, if no more of their signs differ than at the threshold's angle but for one chance in a
million. Vectors are fetched for nodes that have a candidate, and pairs are verified by cosine in
double precision where they meet; a unit hands on link counts and a spanning forest, not pairs, and
the forests of all passes are united.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors
without label, link with nothing; vectors of different length are not compared. A null vec_id
takes part in links; component_id is the smallest id that is not null. Repeated rows are vectors
of their own; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textnum as t
from tessera.llm.shared import UnitLinks, blocked_units, by_runs, classes_of, run_starts, unit_pairs
from tessera.operators.tables import written

WINDOW = 128
BLOCK = 512
MOST_BITS = 40
LEAST_SIGNS = 256
SEGMENT_BITS = 4  # codes that are equal but for their last bits are sorted by one task
U = np.uint64


def pass_plan(largest: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, passes) for labels of up to ``largest`` nodes."""
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(2, 2 * largest / WINDOW)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def most_different(signs: int, threshold: float, missed: float = 1e-6) -> int:
    """How many of the signs may differ for a pair at the threshold, but for the chance ``missed``."""
    p, below = math.acos(threshold) / math.pi, 0.0
    for k in range(signs):
        below += math.exp(math.lgamma(signs + 1) - math.lgamma(k + 1) - math.lgamma(signs - k + 1) + k * math.log(p) + (signs - k) * math.log1p(-p)) if p > 0 else 1.0
        if below >= 1 - missed:
            return k
    return signs


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Lengths of the vectors, and rows and matrix for each length."""
    vectors = vectors.cast(pa.large_binary())
    off = np.frombuffer(vectors.buffers()[1], np.int64, len(vectors) + 1, vectors.offset * 8)
    data, size = np.frombuffer(vectors.buffers()[2] or b"", np.uint8), np.diff(off) // 8
    out = []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        out.append((at, data[(off[at][:, None] + np.arange(d * 8)).ravel()].view(np.float64).reshape(-1, d)))
    return size, out


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, node (null if the vector can't link), label, the vector's doubles as bytes."""
    for batch in batches:
        vectors, labels = batch.column(1), batch.column(2).cast(pa.int64())
        off = vectors.offsets.to_numpy()
        values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null becomes nan
        known = labels.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False)
        label, size = labels.fill_null(0).to_numpy(), np.diff(off)
        node, raw, bad = np.zeros(len(vectors), np.int64), [b""] * len(vectors), np.ones(len(vectors), bool)
        for d in np.unique(size[known]):
            at = np.flatnonzero(known & (size == d))
            x = values[(off[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)
            good = np.isfinite(x).all(1) & x.any(1)
            at, x = at[good], x[good]
            whole = np.column_stack([x.view(U), label[at].view(U), np.full(len(at), d, U)])
            h = t.mix(whole * (U(2) * np.arange(d + 2, dtype=U) + U(0x9E3779B97F4A7C15))).sum(1)
            node[at], bad[at] = t.mix(h).view(np.int64), False
            for i, v in zip(at, x, strict=True):
                raw[i] = v.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, mask=bad), labels, pa.array(raw, pa.binary(), mask=bad)], ["vec_id", "node", "label", "vector"])


def _signs(signs: int, seed: int):
    """node, signs: the signs of projections, packed."""
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, signs // 8), np.uint8)
            for at, x in _matrix(batch.column(1))[1]:
                d = x.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, signs))
                for c in range(0, len(at), 5_000):
                    part = x[c : c + 5_000]
                    out[at[c : c + 5_000]] = np.packbits(part / np.abs(part).max(1, keepdims=True) @ planes[d] > 0, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out.reshape(-1).tobytes()[i : i + signs // 8] for i in range(0, out.size, signs // 8)), pa.binary())], ["node", "signs"])

    return run


def codes(packed: np.ndarray, bits: int, passes: int) -> np.ndarray:
    """The code of each pass, from packed signs."""
    own = np.unpackbits(packed, axis=1)[:, : bits * passes].reshape(len(packed), passes, bits).astype(np.int64)
    return own @ (np.int64(1) << np.arange(bits, dtype=np.int64)[::-1])


def _packed(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)


def _codes(bits: int, passes: int):
    """node, signs, turn, code for each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, batch.num_rows, 2_000):
                part = batch.slice(c, 2_000)
                at = pa.array(np.repeat(np.arange(part.num_rows), passes))
                code = codes(_packed(part.column(3)), bits, passes)
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(at) for k in range(4)], pa.array(np.tile(np.arange(passes, dtype=np.int32), part.num_rows)), pa.array(code.ravel())], ["node", "label", "d", "signs", "turn", "code"])

    return run


def _near(packed: np.ndarray, x: np.ndarray, y: np.ndarray, turn: np.ndarray, bits: int, passes: int, most: int) -> np.ndarray:
    """Whether pairs share the code of their pass first, and few signs differ."""
    good = np.bitwise_count(packed[x] ^ packed[y]).sum(1, dtype=np.int64) <= most
    at = np.flatnonzero(good)
    good[at] = (codes(packed[x[at]], bits, passes) == codes(packed[y[at]], bits, passes)).argmax(1) == turn[x[at]] if len(at) else False
    return good


def _candidates(bits: int, passes: int, most: int, sorted_runs: bool):
    """unit, side, turn, node of nodes with a candidate in the unit. ``sorted_runs``: rows are in
    order of (segment, code), and each is compared with those that follow it in its run; else all
    pairs of blocks are."""

    def windows(unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(1, WINDOW):
            x = np.flatnonzero(unit[k:] == unit[:-k])
            if not len(x):
                return
            yield x, x + k

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, side, turn, node = (table.column(c).to_numpy() for c in ("unit", "side", "turn", "node"))
        packed, hit = _packed(table.column("signs")), np.zeros(len(unit), bool)
        for x, y in windows(unit) if sorted_runs else unit_pairs(run_starts(unit), side):
            good = _near(packed, x, y, turn, bits, passes, most)
            hit[x[good]] = hit[y[good]] = True
        yield pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in (unit, side, turn, node)], ["unit", "side", "turn", "node"])

    return by_runs("segment" if sorted_runs else "unit", handle, rows=20_000)


def _links(bits: int, passes: int, most: int, threshold: float):
    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        turn, side, node, mult = (table.column(c).to_numpy() for c in ("turn", "side", "node", "mult"))
        vectors, packed = table.column("vector").combine_chunks(), _packed(table.column("signs"))
        out: list[list[np.ndarray]] = [[], [], []]
        starts = run_starts(table.column("unit").to_numpy())
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            ((_, x),) = _matrix(vectors.slice(a, b - a))[1]
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            near = x @ x.T >= threshold
            links = UnitLinks(node[a:b], mult[a:b])
            for p, q in unit_pairs(np.array([0, b - a]), side[a:b]):
                good = near[p, q]
                p, q = p[good], q[good]
                first = _near(packed[a:b], p, q, turn[a:b], bits, passes, most)
                links.add(p[first], q[first])
            for o, v in zip(out, links.rows(), strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["node", "links", "root"])

    return by_runs("unit", handle, rows=5_000)


def near_vectors(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.99999, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label)."""
    source = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long"))
    rows = source.mapInArrow(_valid, "vec_id long, node long, label long, vector binary")
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("mult"), F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.first("vector").alias("vector")), "nodes")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, passes = pass_plan(largest, threshold, recall)
    signs = -(-max(LEAST_SIGNS, bits * passes) // 8) * 8
    most = most_different(signs, threshold)
    signed = written(nodes.select("node", "vector").mapInArrow(_signs(signs, seed), "node long, signs binary"), "signs")

    labelled = signed.join(nodes.select("node", "label", F.octet_length("vector").alias("d")), "node").select("node", "label", "d", "signs")
    held = labelled.mapInArrow(_codes(bits, passes), "node long, label long, d int, signs binary, turn int, code long")
    held = held.withColumn("key", F.xxhash64("label", "d", "turn", "code"))
    longer = written(held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > WINDOW).select("key"), "runs")
    segment = F.xxhash64("label", "d", "turn", F.shiftright("code", SEGMENT_BITS)).alias("segment")
    short = held.join(longer, "key", "left_anti").select("node", "signs", "turn", F.col("key").alias("unit"), F.lit(0).cast("byte").alias("side"), segment, "code")
    kinds = "unit long, side byte, turn int, node long"
    passed = short.repartition("segment").sortWithinPartitions("segment", "code", "unit").mapInArrow(_candidates(bits, passes, most, True), kinds)
    blocks = blocked_units(held.join(longer, "key", "left_semi").select("node", "signs", "turn", "key"), BLOCK).drop("key")
    dense = blocks.repartition("unit").sortWithinPartitions("unit").mapInArrow(_candidates(bits, passes, most, False), kinds)
    met = written(passed.unionByName(dense), "candidates")

    full = met.join(nodes.select("node", "mult", "vector").join(signed, "node"), "node")
    found = written(full.repartition("unit").sortWithinPartitions("unit").mapInArrow(_links(bits, passes, most, threshold), "node long, links long, root long"), "links")
    of = classes_of(nodes.select("node", "mult", "rep"), found)
    joined = rows.select("vec_id", "node").join(of, "node", "left")
    joined = joined.withColumn("component_id", F.coalesce("class_id", "vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
