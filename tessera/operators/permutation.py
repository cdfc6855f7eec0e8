"""Permutation of whole treatment paths between units, with all draws as sums over pairs of units.

With fixed effects taken out, the coefficient of a draw needs products of y, of the moderator and of the
path that each unit takes over. All of them are sums over units of what one unit and the unit
whose path it takes give: products with the freed y and moderator, squares less those of unit means,
and, for time effects, sums by period, on which the inverse of the system of periods works at the
end. So the products make up a table of units by units, of which a draw takes one entry a unit. Units
are cut into blocks; the entries that a chunk of draws takes in a block of units and a block of
paths are one group, which gets the two blocks. Nothing but a period's or a draw's numbers ever comes
to the driver or is sent to every task, and orders are drawn in the tasks.

Orders follow one seeded sequence. A permutation takes a varying number of its numbers, as some are
rejected, so a chunk's place in the sequence can't be computed; one task runs through it once and notes the
state of the generator at the start of each chunk.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.operators.fixed_effects import MOST_PERIODS, demeaned, facts_of, shared_cells
from tessera.operators.ranks import ranked
from tessera.operators.tables import written

#: Draws of a chunk, and entries of a block of units by periods.
CHUNK, BLOCK = 64, 1 << 20
#: Entries that are worked on at once.
PORTION = 1 << 21
SUMS = "draw long, k int, v double"
CELL = "s int, i int, j int, kind int, draw long, data binary"
OBSERVED = -1


@dataclass
class Sample:
    """Units in blocks: own holds (block, data), matrices of units by periods of the freed y and,
    with a moderator, of the freed and the plain one, NaN where there is no row; paths holds the
    paths. fixed: products of the freed moderator with itself and with y."""

    own: DataFrame
    paths: DataFrame
    units: int
    block: int
    periods: int
    unit_effects: bool
    solve: np.ndarray  # inverse of the system of periods, or of the number of rows
    fixed: tuple[float, float] | None
    index: DataFrame  # unit, at: its number in order


def _blocked(rows: DataFrame, periods: list[float], block: int, columns: list[str]) -> DataFrame:
    """block, data: for each column a matrix of the block's units by periods, from rows (at, time, columns)."""
    times, width = np.array(periods), len(columns)

    def run(table: pa.Table) -> pa.Table:
        at = table.column("at").to_numpy()
        out = np.full((width, block, len(times)), np.nan)
        where = np.searchsorted(times, table.column("time").to_numpy())
        for c, name in enumerate(columns):
            out[c, at % block, where] = table.column(name).to_numpy()
        return pa.table({"block": pa.array([int(at[0]) // block], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    doubles = [F.col(c).cast("double").alias(c) for c in ("time", *columns)]
    return rows.select("at", *doubles, (F.col("at") / block).cast("int").alias("block")).groupBy("block").applyInArrow(run, "block int, data binary")


def sample_of(clean: DataFrame, paths: DataFrame, effects: list[str], moderated: bool) -> Sample:
    """The sample from clean rows (unit, time, y, moderator) and complete paths (unit, time, treatment)."""
    effects = [e for e in ("unit", "time") if e in effects]
    names = ["y", *(["moderator"] if moderated else [])]
    clean, paths = written(clean.select("unit", "time", *names), "clean"), written(paths.select("unit", "time", "treatment"), "paths")
    of_periods = paths.groupBy(F.col("time").cast("double").alias("time")).agg(F.count("*").alias("n"), F.avg("treatment").alias("mean")).orderBy("time").collect()
    periods, units = [r["time"] for r in of_periods], max((r["n"] for r in of_periods), default=0)  # every unit has every period
    facts = facts_of(clean, names)
    if units < 3 or not facts["n"]:
        raise EngineError("permutation_empty", "at least three units with a complete path are needed")
    if "time" in effects and len(periods) > MOST_PERIODS:
        raise EngineError("permutation_periods", f"time effects of more than {MOST_PERIODS} periods can't be permuted")
    if "time" in effects:
        sizes = {r["time"]: r["n"] for r in clean.groupBy("time").agg(F.count("*").alias("n")).collect()}
        system, at = np.diag([float(sizes.get(t, 0)) for t in periods]), {t: k for k, t in enumerate(periods)}
        if "unit" in effects:
            for r in shared_cells(clean, "unit", "time"):
                system[at[r["s"]], at[r["r"]]] -= r["v"]
    else:
        system = np.array([[0.0 if "unit" in effects else float(facts["n"])]])
    free = demeaned(clean.withColumn("plain", F.col(names[-1]) - float(facts[f"mean_{names[-1]}"])), names, effects, facts)
    fixed = free.agg(F.sum(F.col("moderator") * F.col("moderator")), F.sum(F.col("moderator") * F.col("y"))).first() if moderated else None
    mean = float(np.mean([r["mean"] for r in of_periods]))  # a constant is in all effects and in the main effects; products are smaller without
    index = ranked(paths.select("unit").distinct(), [], [F.col("unit")], "at").select("unit", (F.col("at") - 1).alias("at"))
    block = max(1, min(units, BLOCK // len(periods)))
    own = _blocked(free.join(index, "unit"), periods, block, [*names, *(["plain"] if moderated else [])])
    centred = paths.withColumn("treatment", F.col("treatment") - F.lit(mean))
    return Sample(own, _blocked(centred.join(index, "unit"), periods, block, ["treatment"]), units, block, len(periods), "unit" in effects, np.linalg.pinv(system, rcond=1e-12), tuple(fixed) if moderated else None, index)


def _states(units: int, draws: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            rng = np.random.default_rng(seed)
            for first in range(0, draws, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([first // CHUNK], pa.int32()), pa.array([json.dumps(rng.bit_generator.state)])], ["s", "state"])
                for _ in range(CHUNK if first + CHUNK < draws else 0):
                    rng.permutation(units)

    return run


def seeded_orders(spark: SparkSession, units: int, draws: int, seed: int) -> tuple[DataFrame, Callable]:
    """Chunks of draws with the generator's state, and a function that draws their orders; the last
    chunk leaves the paths where they are."""
    states = written(spark.range(1).coalesce(1).mapInArrow(_states(units, draws, seed), "s int, state string"), "states")
    observed = spark.range(1).select(F.lit(-1).alias("s"), F.lit(None).cast("string").alias("state"))

    def orders(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        for s, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None:
                yield s, OBSERVED, np.arange(units)
                continue
            rng = np.random.default_rng()
            rng.bit_generator.state = json.loads(state)
            for draw in range(s * CHUNK, min(draws, (s + 1) * CHUNK)):
                yield s, draw, rng.permutation(units)

    return states.unionByName(observed).repartition(-(-draws // CHUNK) + 1, "s"), orders


def listed_orders(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Orders from rows (draw, donors): the list of whose path each unit takes."""
    for draw, donors in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield draw // CHUNK, draw, donors.values.to_numpy()


def _entries(block: int, orders: Callable):
    """Rows of CELL: the draw, and unit and path of each entry that an order takes in a cell, made for one
    block of units at a time, so that beside an order itself nothing grows with the number of units. As a
    draw leaves 1 / n of a block's entries in each of its n cells, n chunks make up a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = lambda x: pa.array(np.asarray(x, np.int32))
        for batch in batches:
            for s, draw, donors in orders(batch):
                group = s if draw == OBSERVED else s // -(-len(donors) // block)
                for i in range(0, len(donors), block):
                    part = donors[i : i + block]
                    cell = part // block
                    turn = np.argsort(cell, kind="stable")
                    cuts = np.flatnonzero(np.r_[True, np.diff(cell[turn]) != 0, True])
                    data = np.stack([turn, part[turn] % block], 1).astype(np.int32)
                    rows = [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([ints(np.full(n, group)), ints(np.full(n, i // block)), ints(cell[turn[cuts[:-1]]]), ints(np.full(n, 2)), pa.array(np.full(n, draw, np.int64)), pa.array(rows, pa.binary())], ["s", "i", "j", "kind", "draw", "data"])

    return run


def _portions(parts: list[pa.Buffer], draw: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Draw, unit and path of the entries, in order, about ``most`` at once."""
    held, n = [], 0
    for k, part in enumerate(parts):
        entries = np.frombuffer(part, np.int32).reshape(-1, 2)
        for c in range(0, len(entries), most):
            held.append((draw[k], entries[c : c + most]))
            n += len(held[-1][1])
            if n >= most:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = np.concatenate([e for _, e in held])
    return np.repeat([d for d, _ in held], [len(e) for _, e in held]), both[:, 0], both[:, 1]


def _products(periods: int, block: int, moderated: bool, unit_effects: bool, time_effects: bool):
    """Rows of SUMS of a cell. Of the path d and its product z with the moderator, k counts: products with
    the freed y (and moderator), products among them, sums by period."""

    def run(table: pa.Table) -> pa.Table:
        kind, data = table.column("kind").to_numpy(), table.column("data")
        matrices = {int(k): np.frombuffer(data[int(r)].as_buffer(), np.float64).reshape(-1, block, periods) for r, k in enumerate(kind) if k < 2}
        rows_of = np.flatnonzero(kind == 2)
        rows_of = rows_of[np.argsort(table.column("draw").to_numpy()[rows_of], kind="stable")]
        draw_of = table.column("draw").to_numpy()[rows_of].astype(np.int64)
        draws, sums = np.unique(draw_of), None
        for draw, u, v in _portions([data[int(r)].as_buffer() for r in rows_of], draw_of, max(1, PORTION // periods)):
            own = matrices[0][:, u]
            there = ~np.isnan(own[0])
            n = np.maximum(there.sum(1), 1)[:, None]
            d = [np.where(there, matrices[1][0][v], 0.0)]
            if moderated:
                d.append(d[0] * np.where(there, own[2], 0.0))
            freed = [np.where(there, x, 0.0) for x in own[: 2 if moderated else 1]]
            lean = [x - np.where(there, x.sum(1, keepdims=True) / n, 0.0) for x in d] if unit_effects else d
            parts = [(f * x).sum(1) for f in freed for x in d] + [(a * b).sum(1) for k, a in enumerate(lean) for b in lean[k:]]
            by_period = lean if time_effects else [x.sum(1, keepdims=True) for x in lean]
            rows = np.concatenate([np.stack(parts, 1), *by_period], 1)
            start = np.flatnonzero(np.r_[True, draw[1:] != draw[:-1]])
            sums = np.zeros((len(draws), rows.shape[1])) if sums is None else sums
            sums[np.searchsorted(draws, draw[start])] += np.add.reduceat(rows, start)
        if sums is None:
            return pa.table({"draw": pa.array([], pa.int64()), "k": pa.array([], pa.int32()), "v": pa.array([], pa.float64())})
        return pa.table({"draw": np.repeat(draws, sums.shape[1]), "k": np.tile(np.arange(sums.shape[1], dtype=np.int32), len(draws)), "v": sums.ravel()})

    return run


def _solved(solve: np.ndarray, fixed: tuple[float, float] | None):
    """(draw, coef) from the sums of draws, in order of k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1):
                v = row.values.field("v").to_numpy(zero_copy_only=False)
                with np.errstate(all="ignore"):
                    out.append(_alone(v, solve) if fixed is None else _beside_main_effects(v, solve, *fixed))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["draw", "coef"])

    return run


def _alone(v: np.ndarray, solve: np.ndarray) -> float:
    yd, dd, h = v[0], v[1], v[2:]
    below = dd - h @ solve @ h
    return yd / below if below > 1e-12 else np.nan


def _beside_main_effects(v: np.ndarray, solve: np.ndarray, mm: float, my: float) -> float:
    """The product's coefficient where both main effects are held: they are eliminated from it."""
    yd, yz, md, mz, dd, dz, zz = v[:7]
    hd, hz = v[7:].reshape(2, -1)
    dd, dz, zz = dd - hd @ solve @ hd, dz - hd @ solve @ hz, zz - hz @ solve @ hz
    main = np.array([[dd, md], [md, mm]])
    if np.linalg.det(main) <= 1e-12:
        return np.nan
    share = np.linalg.solve(main, [dz, mz])
    below = zz - share @ [dz, mz]
    return (yz - share @ [yd, my]) / below if below > 1e-12 else np.nan


def coefficients(sample: Sample, chunks: DataFrame, orders: Callable) -> DataFrame:
    """(draw, coef) of the orders that ``orders`` yields (chunk, draw, order) from batches of
    ``chunks``; NaN where a coefficient can't be estimated."""
    n = -(-sample.units // sample.block)
    entries = written(chunks.mapInArrow(_entries(sample.block, orders), CELL), "entries")
    cells = entries.select("s", "i", "j").distinct()
    own = cells.join(sample.own, F.col("i") == F.col("block")).select("s", "i", "j", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("draw"), "data")
    paths = cells.join(sample.paths, F.col("j") == F.col("block")).select("s", "i", "j", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("draw"), "data")
    moderated, times = sample.fixed is not None, sample.solve.shape[0] > 1 or sample.periods == 1
    grouped = entries.unionByName(own).unionByName(paths).repartition(max(n * n, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "s", "i", "j").groupBy("s", "i", "j")
    sums = grouped.applyInArrow(_products(sample.periods, sample.block, moderated, sample.unit_effects, times), SUMS)
    by_draw = sums.groupBy("draw", "k").agg(F.sum("v").alias("v")).groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("sums"))
    return written(by_draw.mapInArrow(_solved(sample.solve, sample.fixed), "draw long, coef double"), "draws")
