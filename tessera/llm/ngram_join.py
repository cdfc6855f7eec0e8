"""N-gram Jaccard join by MinHash banding, verified on the full sets of word n-grams.

Documents with equal sets are one node with a multiplicity, so copies cost nothing more. Each node
has ``bands`` keys of ``rows`` minima; both are chosen so that a pair at the threshold shares a key
with the target recall. Nodes are shuffled by key. A key held by many nodes is cut into blocks of
BLOCK nodes and every pair of blocks is a unit of work of its own, so no task holds a group and
none is capped. A pair is looked at in the first band it shares only: other units see that an
earlier key is equal. Units that have such a pair fetch the full sets, count exact links and hand
on, for each node, its number of links and one edge of a spanning forest, never the pairs.

Defined results: texts without words link with nothing; texts of fewer than n words are one n-gram
of all their words; words are split at ASCII white space, ASCII case does not count; a node is
known by a 64-bit hash of its set. A null id takes part in links, and a class takes the smallest
id that is not null. Repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textnum as t
from tessera.llm.shared import UnitLinks, blocked_units, by_runs, classes_of, fresh, matrix, named, run_starts, unit_pairs
from tessera.operators.tables import written

U = np.uint64
BLOCK = 512


def band_plan(threshold: float, recall: float = 0.9999, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands, as many as the recall at the threshold takes,
    stay within ``most`` hashes."""
    fits = [(b, r) for r in range(1, 17) if (b := math.ceil(math.log(1 - recall) / math.log(1 - threshold**r))) * r <= most]
    return max(fits, key=lambda x: x[1]) if fits else (most, 1)


def distinct_sets(sh: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, and their offsets."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((sh, row))
    sh, row = sh[order], row[order]
    keep = np.r_[True, (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])] if len(sh) else np.zeros(0, bool)
    return sh[keep], np.searchsorted(row[keep], np.arange(len(off)))


def sets_of(col: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, off in t.column_blocks(col):
        start, end, first = t.words(data, off)
        yield i, j, *distinct_sets(*t.shingles(t.word_hashes(data, start, end), first, n))


def node_ids(sh: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the rows that have n-grams, and the hashes of their sets."""
    has = np.flatnonzero(np.diff(off))
    if not len(has):
        return has, np.zeros(0, np.int64)
    total = np.add.reduceat(t.mix(sh ^ U(0x5851F42D4C957F2D)), off[has]) + np.diff(off)[has].astype(U)
    return has, t.mix(total).view(np.int64)


def _signatures(n: int, bands: int, rows: int, seed: int):
    factors = np.random.default_rng(seed).integers(0, 1 << 63, (bands, rows), np.uint64) * U(2) + U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sh, off in sets_of(batch.column(1), n):
                has, node = node_ids(sh, off)
                keys = np.zeros((len(has), bands), U)
                if len(has):
                    for b in range(bands):
                        acc = np.full(len(has), U(b + 1), U)
                        for f in factors[b]:
                            acc = t.mix(acc ^ np.minimum.reduceat(sh * f, off[has]))
                        keys[:, b] = acc
                size = np.zeros(j - i + 1, np.int32)
                size[1:][has] = bands
                full = np.zeros(j - i, np.int64)
                full[has] = node
                none = np.ones(j - i, bool)
                none[has] = False
                keyed = pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(full, mask=none), keyed, batch.column(2).slice(i, j - i)], ["doc_id", "node", "keys", "carried"])

    return run


def _first_shared(keys: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (keys[x] == keys[y]).argmax(1)


def _candidates(bands: int):
    """Keeps the rows of units that stand in a pair whose first shared band is the unit's."""

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = matrix(table.column("keys"), bands)
        band, side = table.column("band").to_numpy(), table.column("side").to_numpy()
        take = np.zeros(len(band), bool)
        for p, q in unit_pairs(run_starts(table.column("unit").to_numpy()), side):
            good = _first_shared(keys, p, q) == band[p]
            take[p[good]] = True
            take[q[good]] = True
        yield from table.filter(pa.array(take)).to_batches()

    return by_runs("unit", handle)


def _links(bands: int, threshold: Fraction):
    """Per unit and node: the multiplicity of its exact links there, and the smallest node of its
    part of the unit's graph."""

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = matrix(table.column("keys"), bands)
        band, side, node, mult = (table.column(c).to_numpy() for c in ("band", "side", "node", "mult"))
        sets = table.column("grams").combine_chunks()
        grams = [np.frombuffer(sets[i].as_buffer(), np.int64) for i in range(len(sets))]
        out: list[list[np.ndarray]] = [[], [], []]
        starts = run_starts(table.column("unit").to_numpy())
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            common = _overlaps(grams[a:b])
            sizes = np.array([len(g) for g in grams[a:b]])
            links = UnitLinks(node[a:b], mult[a:b])
            for p, q in unit_pairs(np.array([0, b - a]), side[a:b]):
                both = common[p, q].astype(np.int64)
                good = both * threshold.denominator >= threshold.numerator * (sizes[p] + sizes[q] - both)
                p, q = p[good], q[good]
                first = _first_shared(keys[a:b], p, q) == band[a]
                links.add(p[first], q[first])
            for o, v in zip(out, links.rows(), strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["node", "links", "root"])

    return by_runs("unit", handle, rows=2_000)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections, by an incidence matrix of the shared n-grams in
    slices of columns."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    place = np.cumsum(shared) - 1
    use = shared[col]
    row, col = row[use], place[col[use]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1024, (8 << 20) // max(1, len(sets)))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, (at, at + width))
        m = np.zeros((len(sets), min(width, int(shared.sum()) - at)), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        common += m @ m.T
    return common


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sh, off in sets_of(batch.column(0), n):
                has, node = node_ids(sh, off)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([sh[off[h] : off[h + 1]].tobytes() for h in has], pa.binary())], ["node", "grams"])

    return run


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: str = "0.8", recall: float = 0.9999, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, node, n_links (other rows whose n-gram sets reach the threshold), class_id
    (smallest id reachable by links, its own included), one row for each row of ``docs``; and its
    column ``carry``, of type long, if given, with component, which is one for each class."""
    bands, rows = band_plan(float(threshold), recall)
    carried = F.lit(None).cast("long") if carry is None else F.col(carry)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), carried.alias("carried"))
    signed = written(source.mapInArrow(_signatures(n, bands, rows, seed), "doc_id long, node long, keys array<long>, carried long"), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.count("*").alias("mult"), F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    nodes = written(nodes, "nodes")
    held = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    units = blocked_units(held, BLOCK).drop("key")
    units = units.join(nodes.select("node", "keys", "mult"), "node")
    paired = written(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_candidates(bands), units.schema), "candidates")
    wanted = paired.select("node").distinct().join(nodes.select("node", "rep"), "node").select(F.col("rep").alias("doc_id")).distinct()
    grams = source.join(wanted, F.coalesce(source["doc_id"], F.lit(-1)) == F.coalesce(wanted["doc_id"], F.lit(-1)), "left_semi").select("text").mapInArrow(_grams(n), "node long, grams binary").dropDuplicates(["node"])
    found = paired.join(grams, "node").repartition("unit").sortWithinPartitions("unit").mapInArrow(_links(bands, Fraction(threshold)), "node long, links long, root long")
    found = written(found, "links")
    of = classes_of(nodes.select("node", "mult", "rep"), found)
    joined = signed.select("doc_id", "node", "carried").join(of, "node", "left")
    out = joined.select("doc_id", "node", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"), "component", "carried")
    return out.drop("component", "carried") if carry is None else out.withColumnRenamed("carried", carry)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each class: of those with its smallest id, the one with the smallest hash of its
    text. A class keeps one of its rows without an id likewise, as an id can't say that it is a
    copy of another document. Rows without words stay."""
    mark, verdict = fresh(docs, "text_hash"), fresh(docs, "verdict")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    options = {"id_col": "doc_id"} | options
    key = named(options["id_col"]).cast("long")
    classes = written(jaccard_classes(marked, carry=mark, **options).where("node is not null").select("doc_id", "component", mark), "classes")
    rows = classes.groupBy("component", "doc_id", mark).agg(F.count("*").alias("n"))
    first = rows.groupBy("component", F.col("doc_id").isNull()).agg(F.min(F.struct(F.col("doc_id"), F.col(mark))).alias("first"))
    first = first.select(F.col("component").alias("_component"), F.col("first.doc_id").alias("_first"), F.col(f"first.{mark}").alias("_hash"))
    # joined by the whole row, so that a large class is spread over tasks
    judged = rows.join(first, (F.col("component") == F.col("_component")) & F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col(mark) == F.col("_hash")), "left")
    is_first = F.col("_component").isNotNull()
    judged = judged.select(F.col("doc_id").alias("_id"), F.col(mark).alias("_mark"), F.when(~is_first, "gone").when(F.col("n") > 1, "repeated").alias(verdict)).where(F.col(verdict).isNotNull())
    judged = written(judged, "judged")
    of = lambda d: (key.eqNullSafe(d["_id"])) & (F.col(mark) == d["_mark"])
    kept = marked.join(judged, of(judged), "left_anti")
    repeated = judged.where(F.col(verdict) == "repeated")
    if not repeated.isEmpty():
        once = fresh(marked, "key")
        again = marked.join(repeated, of(repeated), "left_semi").withColumn(once, key)
        kept = kept.unionByName(again.dropDuplicates([once, mark]).drop(once))
    return kept.select(*[named(c) for c in docs.columns])
