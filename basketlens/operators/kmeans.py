"""Reproducible k-means (M2): the same centres whatever the partitioning.

Spark ML's k-means samples its start by partition and adds doubles in the
order of tasks, so its result hangs on how rows are dealt. Here points are
whole millionths of a standard deviation, so centre sums are exact integers;
starts are drawn by hashes of the row key; ties go to the first centre. Each
centre is the integer sum divided once in double precision, so every step can
be recomputed exactly, by SQL too.

Start: the first centre is the row with the smallest hash, each further one
is drawn with probability in proportion to its squared distance from the
nearest centre (k-means++), as the smallest -ln(u) / distance with a hash u.
``starts`` of them run side by side; the one of least inertia is kept.

A step sums the points of each centre with numpy inside the tasks (centres
change with every step, and an expression of them would be compiled anew each
time); a row per task, start and centre comes to the driver, however many
points there are. Distances are added column by column,
so numpy, Spark and SQL give the same bits.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])      # executors need no installed package

UNIT = 1_000_000          # points are in millionths


def units(z: Column) -> Column:
    """A standardised feature as whole millionths."""
    return F.round(z * F.lit(float(UNIT))).cast("long")


def uniform(key: str, seed: int, start: int, step: int) -> Column:
    """In (0, 1], from 52 bits of the md5 of seed, start, step and key."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(start)), F.lit(str(step)), F.col(key).cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(1.0)) / F.lit(float(1 << 52))


def distances(cols: list[str], centres: list[list[float]]) -> list[str]:
    """SQL of the squared distance from a point to each centre, added column by column."""
    return [" + ".join(f"(double(`{c}`) - {x!r}D) * (double(`{c}`) - {x!r}D)" for c, x in zip(cols, centre)) for centre in centres]


def least(to: list[str]) -> str:
    return f"least({', '.join(to)})" if len(to) > 1 else to[0]


def nearest(cols: list[str], centres: list[list[float]]) -> Column:
    """Number of the nearest centre, the first of equal ones."""
    to = distances(cols, centres)
    return F.expr(f"int(array_position(array({', '.join(to)}), {least(to)}) - 1)")


def _near(batch: pa.RecordBatch, cols: list[str], centres: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, number of each one's nearest centre, squared distance to it) of a batch; ``nearest`` in numpy."""
    points = np.stack([batch.column(c).to_numpy() for c in cols])
    to = np.stack([reduce(np.add, [(x - c) * (x - c) for x, c in zip(points.astype(np.float64), centre)]) for centre in centres])
    return points, to.argmin(0), to.min(0)


def _steps(cols: list[str], centres: dict[int, list[list[float]]]):
    """Sums of a task's points: a row per start and centre."""
    def step(batches):
        k = len(next(iter(centres.values())))
        sums = {start: np.zeros((len(cols) + 1, k), np.int64) for start in centres}
        for batch in batches:
            for start, mine in centres.items():
                points, number, _ = _near(batch, cols, mine)
                for row, x in zip(sums[start], [1, *points]):
                    np.add.at(row, number, x)
        for start, rows in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([start] * k, pa.int32()), pa.array(np.arange(k, dtype=np.int32)), *[pa.array(row) for row in rows]], names=["start", "near", "n", *cols])
    return step


def _inertias(cols: list[str], centres: list[list[list[float]]]):
    """Whole squared distances of a task's points, summed in two halves that cannot overflow: a row per start."""
    def total(batches):
        high, low = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        for batch in batches:
            for s, mine in enumerate(centres):
                whole = np.floor(_near(batch, cols, mine)[2]).astype(np.int64)
                high[s] += (whole >> 24).sum()
                low[s] += (whole & 0xFFFFFF).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(high), pa.array(low)], names=["start", "high", "low"])
    return total


@dataclass
class Fit:
    centres: list[list[float]]      # in millionths, sorted
    inertia: int                    # sum of whole squared distances
    steps: int                      # of the start that was kept


def fit(points: DataFrame, key: str, cols: list[str], k: int, seed: int, starts: int, max_iter: int, tol: float) -> Fit:
    """k-means of ``points`` (``key`` and ``cols`` in millionths, no nulls); ``k`` at most the number of rows.

    A start is done when its centres' squared shifts add up to at most ``tol``
    (in squared millionths) or after ``max_iter`` steps. A centre without
    points stays where it is. Rows with equal keys are points of their own.
    """
    pick = F.struct(*[F.col(c) for c in cols])

    def drawn(weights: list[Column]) -> list[list[float] | None]:
        """For each start, the point of the smallest weight (null weights do not count)."""
        row = points.agg(*[F.min_by(pick, F.struct(w.isNull(), w, F.col(key))).alias(f"c{s}") for s, w in enumerate(weights)],
                         *[F.count(w).alias(f"n{s}") for s, w in enumerate(weights)]).first()
        return [[float(x) for x in row[f"c{s}"]] if row[f"n{s}"] else None for s in range(starts)]

    centres = [[c] for c in drawn([uniform(key, seed, s, 0) for s in range(starts)])]
    for step in range(1, k):
        far = [F.expr(least(distances(cols, centres[s]))) for s in range(starts)]
        more = drawn([F.when(d > 0, -F.log(uniform(key, seed, s, step)) / d) for s, d in enumerate(far)])
        for s in range(starts):
            centres[s].append(more[s] or centres[s][0])
    live, steps = list(range(starts)), [0] * starts
    schema = "start int, near int, n long, " + ", ".join(f"{c} long" for c in cols)
    while live:
        rows = points.select(*cols).mapInArrow(_steps(cols, {s: centres[s] for s in live}), schema).collect()        # a row per task, start and centre
        total: dict[tuple[int, int], list[int]] = {}
        for r in rows:
            mine = total.setdefault((r["start"], r["near"]), [0] * (len(cols) + 1))
            for i, x in enumerate(r[2:]):
                mine[i] += x
        moved = {at: [float(x) / n for x in sums] for at, (n, *sums) in total.items() if n}
        going = []
        for s in live:
            new = [moved.get((s, j), centres[s][j]) for j in range(k)]
            shift = 0.0
            for a, b in zip(new, centres[s]):
                for x, y in zip(a, b):
                    shift += (x - y) * (x - y)
            centres[s], steps[s] = new, steps[s] + 1
            if shift > tol and steps[s] < max_iter:
                going.append(s)
        live = going
    parts = points.select(*cols).mapInArrow(_inertias(cols, centres), "start int, high long, low long")
    inertia = [0] * starts
    for r in parts.collect():                                                         # a row per task and start
        inertia[r["start"]] += int(r["high"]) * (1 << 24) + int(r["low"])
    best = min(range(starts), key=lambda s: (inertia[s], s))
    return Fit(sorted(centres[best]), inertia[best], steps[best])
