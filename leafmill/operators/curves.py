"""Fewer segments for drawn curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far area and box of a merged curve may differ from those of its segments.
TOLERANCE = 0.1


def _area(p: np.ndarray) -> float:
    """Area that the line from the origin to the curve's point sweeps."""
    x, y = p[:, 0], p[:, 1]
    c = lambda i, j: x[i] * y[j] - x[j] * y[i]
    return (6 * c(0, 1) + 3 * c(0, 2) + c(0, 3) + 3 * c(1, 2) + 3 * c(1, 3) + 6 * c(2, 3)) / 20


def _bounds(p: np.ndarray) -> np.ndarray:
    t = np.linspace(0, 1, 17)[:, None]
    q = (1 - t) ** 3 * p[0] + 3 * t * (1 - t) ** 2 * p[1] + 3 * t**2 * (1 - t) * p[2] + t**3 * p[3]
    return np.concatenate([q.min(axis=0), q.max(axis=0)])


def joined(run: list[np.ndarray]) -> np.ndarray | None:
    """One segment with the run's ends and end directions that sweeps the same area, or None."""
    a, d = run[0][0], run[-1][3]
    u, v = run[0][1] - a, run[-1][2] - d
    total = len(run)
    target = sum(_area(s) for s in run)
    make = lambda k: np.array([a, a + u * k, d + v * k, d])
    base, one = _area(make(0.0)), _area(make(1.0))
    quad = (_area(make(2.0)) - 2 * one + base) / 2
    lin = one - base - quad
    roots = np.roots([quad, lin, base - target]) if abs(quad) > 1e-12 else np.array([(target - base) / lin]) if abs(lin) > 1e-12 else np.array([float(total)])
    roots = roots[np.isreal(roots)].real
    roots = roots[roots > 0]
    return make(roots[np.argmin(np.abs(roots - total))]) if len(roots) else None


def decimate(points: np.ndarray, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """Segments of a path (n, 4, 2), neighbours merged greedily while area and box stay within tolerance."""
    out: list[np.ndarray] = []
    run: list[np.ndarray] = []
    best: np.ndarray | None = None
    for s in points:
        trial = joined([*run, s]) if run and np.allclose(run[-1][3], s[0]) else None
        if trial is not None:
            want = np.array([_bounds(r) for r in [*run, s]])
            want = np.concatenate([want[:, :2].min(axis=0), want[:, 2:].max(axis=0)])
            area = abs(_area(trial) - sum(_area(r) for r in [*run, s]))
            if area <= tolerance and np.abs(_bounds(trial) - want).max() <= tolerance:
                run.append(s)
                best = trial
                continue
        if best is not None:
            out.append(best)
        run, best = [s], s
    return [*out, best] if best is not None else out


def decimated(paths: DataFrame, key: str, points: str = "points", tolerance: float = TOLERANCE) -> DataFrame:
    """(key, segments, points): each row's path (eight numbers a segment) with fewer segments."""
    kind = paths.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decimate(np.array(x or [], float).reshape(-1, 4, 2), tolerance) for x in b.column(1).to_pylist()]
            flat = [np.concatenate([s.ravel() for s in g]).tolist() if g else [] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(g) for g in got], pa.int32()), pa.array(flat, pa.list_(pa.float64()))], ["key", "segments", "points"])

    return paths.select(key, F.col(points).cast("array<double>").alias("points")).mapInArrow(run, f"key {kind}, segments int, points array<double>").withColumnRenamed("key", key)
