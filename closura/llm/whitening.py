"""Whitening of embeddings with an exact covariance, by digit slices.

Entries become integers, x = floor(64 * c) + 1000000.  The fit list is each distinct vector
of them once, ``n`` vectors with sums ``S``.  Vectors are centred as integers, n * x - S,
and split into limbs of ``BITS`` bits.  A product of two limbs has 2 * ``BITS`` bits and up
to ``ROWS`` are added up, 53 bits in all, so the matrix products that BLAS takes in double
precision are exact.  A task recombines its limbs' products as big integers, and Spark adds
the tasks' matrices up entry by entry, in two parts that its decimals hold.  The covariance
is rounded to double precision once, at the end, and only it goes to the driver, where its
eigenvectors are found: it is as large as the vectors' length squared, whatever their number.

Cases: rows with a null vector, or one that holds a null, infinite or undefined entry, are
left out.  64 * c is kept within 2**61 either way, so that x is a long.  Vectors of each length are a space of
their own, with its own fit list and components; empty ones have no component.  Repeated
rows are repeated in the result and count once in the fit list; null ids stay null.  A
component without variance (less than rounding can tell from none) has a null ``whitened``,
and the identity's error is over the others (null if there are none).  ``deviation`` is null
where it isn't a long; ``deviation_exact`` has it as text always.  An empty table gives no
rows.  Equal eigenvalues leave the choice of their vectors open; the largest entry of each
vector is positive.  Columns other than the id and the vector are not looked at.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, lean

BITS = 20  # bits of a limb
ROWS = 1 << 13  # rows of one product: 2 * BITS + 13 = 53 bits
COMPONENTS = 16
HALF = 40  # bits of the lower part of what is added up
LIMIT = float(1 << 61)

_SUMS = "length int, i int, j int, high decimal(38,0), low long"
_OUT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c.cast("double") * 64))) + 1000000)


def sound(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has only finite entries."""
    infinite = F.lit(float("inf"))
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == infinite))
    return rows.where(F.col(vector).isNotNull() & ~bad & (F.size(vector) > 0))


def blocks(column: pa.Array):
    """(places, matrix of longs) of the vectors of each length, up to ``ROWS`` at once."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offs)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        for a in range(0, len(at), ROWS):
            some = at[a : a + ROWS]
            yield int(d), some, flat[offs[some][:, None] + np.arange(d)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as longs where they suffice, else as Python's integers."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in sums)
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Slices of ``BITS`` bits, the lowest first; the last one has the sign."""
    out = []
    half = 1 << BITS - 1
    while True:
        low = (y + half & (1 << BITS) - 1) - half  # -half to half - 1
        out.append(low.astype(np.float64))
        y = y - low >> BITS
        if not y.any():
            return out


def gram(y: np.ndarray) -> np.ndarray:
    """The sum of the rows' outer products, as Python's integers."""
    parts = limbs(y)
    by_weight: dict[int, np.ndarray] = {}
    for a, p in enumerate(parts):
        for b, q in enumerate(parts[a:], a):
            g = (p.T @ q).astype(np.int64)  # exact: below 2**53
            by_weight[a + b] = by_weight.get(a + b, 0) + (g if a == b else g + g.T).astype(object)
    return sum(g * (1 << BITS * w) for w, g in by_weight.items())


def _emit(totals: dict):
    """(length, i, j, high, low) of a task's sums by key (length, i) or (length, i, j)."""
    for d, m in totals.items():
        i, j = np.triu_indices(d) if m.ndim == 2 else (np.arange(d), np.zeros(d, int))
        flat = m[i, j] if m.ndim == 2 else m
        for a in range(0, len(flat), 100_000):
            v = [int(t) for t in flat[a : a + 100_000]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(v), d), pa.int32()),
                    pa.array(i[a : a + len(v)], pa.int32()),
                    pa.array(j[a : a + len(v)], pa.int32()),
                    pa.array([Decimal(t >> HALF) for t in v], pa.decimal128(38, 0)),
                    pa.array([t & (1 << HALF) - 1 for t in v], pa.int64()),
                ],
                ["length", "i", "j", "high", "low"],
            )


def _added(parts: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """By length the sums over all tasks, of the size of a covariance."""
    total = parts.groupBy("length", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out: dict = {}
    for r in total.toLocalIterator():
        out.setdefault(r["length"], {})[r["i"], r["j"]] = (int(r["high"]) << HALF) + int(r["low"])
    return out


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length the number of vectors and the sums of their entries."""
    counts = {r["d"]: r["n"] for r in fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()}

    @lean
    def run(batches):
        total: dict = {}
        for batch in batches:
            for d, _, x in blocks(batch.column(0)):
                # in two parts, each far from the bounds of a long
                low, high = (x & (1 << 31) - 1).sum(axis=0), (x >> 31).sum(axis=0)
                total[d] = total.get(d, 0) + high.astype(object) * (1 << 31) + low.astype(object)
        yield from _emit(total)

    found = _added(fit.select("x").mapInArrow(run, _SUMS))
    return {d: (counts[d], [found[d][i, 0] for i in range(d)]) for d in found}


def covariance(fit: DataFrame, means: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """By length the covariance over the fit list, rounded from its exact value."""

    @lean
    def run(batches):
        total: dict = {}
        for batch in batches:
            for d, _, x in blocks(batch.column(0)):
                total[d] = total.get(d, 0) + gram(centred(x, *means[d]))
        yield from _emit(total)

    out = {}
    for d, found in _added(fit.select("x").mapInArrow(run, _SUMS)).items():
        v = np.zeros((d, d))
        cube = means[d][0] ** 3  # the factor n twice, and the divisor
        for (i, j), t in found.items():
            v[i, j] = v[j, i] = t / cube
        out[d] = v
    return out


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), what scales to unit variance (columns; NaN without variance)
    and the share of the trace."""
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    trace = float(np.trace(v))
    none = e <= 4 * len(v) * np.finfo(float).eps * max(float(e[0]), 0.0)
    e = np.where(none, 0.0, e)
    with np.errstate(divide="ignore", invalid="ignore"):
        return e, np.where(none, np.nan, vectors / np.sqrt(e)), np.where(none, 0.0, e / trace if trace > 0 else 0.0)


def project(y: np.ndarray, n: int, scaled: np.ndarray) -> np.ndarray:
    return (y / n).astype(np.float64) @ scaled


def identity_error(fit: DataFrame, means: dict, models: dict) -> dict[int, float | None]:
    """By length the largest entry of the whitened vectors' covariance minus the identity,
    measured over the fit list."""
    kinds = "length int, i int, j int, part double, n long"

    @lean
    def run(batches):
        moments: dict = {}
        for batch in batches:
            for d, _, x in blocks(batch.column(0)):
                n, s = means[d]
                w = project(centred(x, n, s), n, models[d][1])
                m = moments.setdefault(d, [0, 0, 0])
                m[0] += len(w)
                m[1] = m[1] + w.sum(axis=0)
                m[2] = m[2] + w.T @ w
        for d, (rows, first, second) in moments.items():
            k = len(first)
            i, j = np.triu_indices(k)
            part = np.concatenate([first, second[i, j]])
            i, j = np.concatenate([np.arange(k), i]), np.concatenate([np.full(k, -1), j])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(part), pa.array(np.full(len(i), rows))], ["length", "i", "j", "part", "n"])

    got: dict = {}
    for r in fit.select("x").mapInArrow(run, kinds).groupBy("length", "i", "j").agg(F.sum("part").alias("part"), F.sum("n").alias("n")).toLocalIterator():
        got.setdefault(r["length"], {})[r["i"], r["j"]] = r["part"] / r["n"]
    out: dict[int, float | None] = {}
    for d, m in got.items():
        # the vectors were centred before, so their means are rounding errors
        errors = [abs(t - m[i, -1] * m[j, -1] - (i == j)) for (i, j), t in m.items() if j >= 0]
        errors = [t for t in errors if t == t]
        out[d] = max(errors) if errors else None
    return out


def whitened(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """A row for each sound row of ``rows`` and component, up to ``most``."""
    x = sound(rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")), "v").select("vec_id", quantised(F.col("v")).alias("x"))
    fit = cut(x.select("x").distinct())
    means = sums(fit)
    cov = covariance(fit, means)
    models = {d: components(v, most) for d, v in cov.items()}
    errors = identity_error(fit, means, models)

    @lean
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for d, at, x in blocks(batch.column(1)):
                n, s = means[d]
                _, scaled, share = models[d]
                k = len(share)
                y = centred(x, n, s)
                w = project(y, n, scaled)
                wide = y.astype(object) if d * max(abs(int(y.max())), abs(int(y.min()))) ** 2 >= 1 << 63 else y
                dev = [int(t) for t in (wide * wide).sum(axis=1)]
                repeat = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at[repeat])),
                        pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                        pa.array(np.full(len(repeat), n), pa.int64()),
                        pa.array([t if t < 1 << 63 else None for t in dev], pa.int64()).take(pa.array(repeat)),
                        pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel())),
                        pa.array(np.tile(share, len(at)), pa.float64()),
                        pa.array([errors[d]] * len(repeat), pa.float64()),
                        pa.array([str(t) for t in dev], pa.string()).take(pa.array(repeat)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )

    return x.mapInArrow(run, _OUT.format(x.schema["vec_id"].dataType.simpleString()))
