"""Units of comparison, runs of equal keys in Arrow streams, and classes of linked nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import components


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, made from ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def by_runs(unit: str, handle: Callable[[pa.Table], Iterator[pa.RecordBatch]], rows: int = 20_000) -> Callable:
    """A function for mapInArrow over a frame sorted by ``unit`` within partitions: ``handle``
    gets tables of whole units, about ``rows`` rows or one unit at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            keys = batch.column(batch.schema.get_field_index(unit)).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])  # start of the last unit
            if cut == 0 and len(held) > 1 and held[-2].column(batch.schema.get_field_index(unit))[-1].as_py() == keys[0]:
                continue
            done = [*held[:-1], batch.slice(0, cut)] if cut else held[:-1]
            if sum(b.num_rows for b in done):
                yield from handle(pa.Table.from_batches(done).combine_chunks())
            held = [batch.slice(cut)]
            n = held[0].num_rows
        if held:
            yield from handle(pa.Table.from_batches(held).combine_chunks())

    return run


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the length as the last."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]


def blocked_units(held: DataFrame, block: int) -> DataFrame:
    """Units of comparison for a frame of (node, key, ...): the nodes of a key, or, where they
    are more than ``block``, every pair of its blocks. Adds unit, and side: 0 if all rows of the
    unit are to be compared, else 1 and 2 for its two blocks. Keys of one node are left out."""
    size = held.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
    cut = held.join(size, "key").withColumn("_m", F.ceil(F.col("_n") / block).cast("int")).withColumn("_r", F.pmod(F.xxhash64("node"), "_m").cast("int"))
    cut = cut.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    low, high = F.least("_r", "_j"), F.greatest("_r", "_j")
    side = F.when(low == high, 0).when(F.col("_r") == low, 1).otherwise(2).cast("byte")
    return cut.withColumn("unit", F.xxhash64("key", low, high)).withColumn("side", side).drop("_n", "_m", "_r", "_j")


def unit_pairs(starts: np.ndarray, side: np.ndarray, portion: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs to compare in the units that begin at ``starts``, in portions."""
    left, right, n = [], [], 0
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if side[a:b].max() == 0:
            x, y = np.triu_indices(b - a, 1)
        else:
            one, two = np.flatnonzero(side[a:b] == 1), np.flatnonzero(side[a:b] == 2)
            x, y = np.repeat(one, len(two)), np.tile(two, len(one))
        left.append(x + a)
        right.append(y + a)
        n += len(x)
        if n >= portion or b == starts[-1]:
            x, y = np.concatenate(left), np.concatenate(right)
            for c in range(0, len(x), portion):
                yield x[c : c + portion], y[c : c + portion]
            left, right, n = [], [], 0


def matrix(col: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def join_roots(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Gives all indexes that the pairs connect the smallest index among them."""
    while True:
        low = np.minimum(root[x], root[y])
        if (root[x] == low).all() and (root[y] == low).all():
            return
        for at in (root[x], root[y], x, y):
            np.minimum.at(root, at, low)
        while (root[root] != root).any():
            root[:] = root[root]


class UnitLinks:
    """Collects the links found in one unit: for each node the multiplicity of its links, and
    the smallest node of its part of the unit's graph."""

    def __init__(self, node: np.ndarray, mult: np.ndarray) -> None:
        self.node, self.mult = node, mult
        self.count, self.root = np.zeros(len(node), np.int64), np.arange(len(node))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        good = self.node[x] != self.node[y]
        x, y = x[good], y[good]
        np.add.at(self.count, x, self.mult[y])
        np.add.at(self.count, y, self.mult[x])
        join_roots(self.root, x, y)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hit = np.flatnonzero(self.count)
        least = np.full(len(self.node), np.iinfo(np.int64).max)
        np.minimum.at(least, self.root, self.node)
        return self.node[hit], self.count[hit], least[self.root][hit]


def classes_of(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """node, component, class_id, n_links from nodes (node, mult, rep) and links (node, links, root)."""
    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of = nodes.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(group, "node", "left")
    of = of.withColumn("component", F.coalesce("component", "node"))
    reps = of.groupBy("component").agg(F.min("rep").alias("class_id"))
    return of.join(reps, "component").select("node", "component", "class_id", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
