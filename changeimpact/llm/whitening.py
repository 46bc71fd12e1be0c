"""Whitening of embeddings by their leading principal components, found by a block Jacobi-Davidson iteration.

The covariance is never built. All the iteration needs of the rows is the product of the covariance with a few
vectors, a pass over the rows: every task centres its rows first, multiplies them by the vectors and back, and gives
a matrix of dimensions x vectors; these are added up by an aggregation. The driver holds matrices of dimensions x (a
few times the components) alone, whatever the number of rows.

* Rayleigh-Ritz on a search space gives the best eigenpairs so far and their residuals r.
* Pairs whose residual is down to rounding are locked: later vectors are kept orthogonal to them.
* For every open pair the projected correction equation (I - QQ')(V - e I)(I - QQ') t = -r is solved by some MINRES steps;
  all open pairs share the pass of a step. The corrections widen the space; a full space is restarted from its best.
* It ends when all residuals are at rounding level, and fails loudly if that does not happen.

Entries are taken as the integers x = floor(64 * c) + 1000000, so sums are exact; centring subtracts the whole part
of the mean exactly before the rest.

Defined results: rows whose vector is null, empty or has null or non-finite entries are left out, as are rows whose
vector has not the commonest length (ties: the longest). Repeated rows and ids count and come back each; a null vec_id
is kept. Directions without variance (to double precision) are no components, so few or equal rows give fewer components
or none; equal eigenvalues have some orthonormal basis, the same for all rows. Signs: the entry of a component that is
largest by absolute value is positive. A ``deviation`` beyond 64 bits is an error. Columns other than ``vec_id`` and
``embedding`` are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeimpact.llm.common import ship, stage

SCALE, SHIFT = 64, 1_000_000
EXTRA, INNER, OUTER, SEED = 8, 6, 200, 13
EPS = float(np.finfo(np.float64).eps)


@dataclass
class Whitening:
    """n fitted rows, per-dimension sums, components as columns by falling eigenvalue, and how well they whiten."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    usable = vectors.select("vec_id", "embedding").filter(finite & (F.size("embedding") > 0))
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")) + F.lit(SHIFT))
    rows = stage(usable.select("vec_id", x.alias("x"), F.size("embedding").alias("length")), "integers")
    common = rows.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.filter(F.col("length") == (common["length"] if common else 0)).drop("length")


def gathered(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], kind: str = "double") -> np.ndarray:
    """Sum over all rows of ``part`` (a matrix for a matrix of rows), which must be of one shape: the driver gets one matrix."""
    schema = f"place int, value {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                own = part(x)
                total = own if total is None else total + own
        if total is not None:
            flat = np.ascontiguousarray(total).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["place", "value"])

    out = np.zeros(shape, np.int64 if kind == "long" else np.float64)
    for row in rows.select("x").mapInArrow(run, schema).groupBy("place").agg(F.sum("value").alias("value")).collect():
        out.flat[row["place"]] = row["value"]
    return out


def centring(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x - S/n: the whole part of the mean is taken away exactly, then the rest."""
    whole = np.array([round(s / n) for s in sums], np.int64)
    rest = np.array([(s - n * int(w)) / n for s, w in zip(sums, whole)])
    return lambda x: (x - whole).astype(np.float64) - rest


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, a column each; ``product`` is asked once a step for all of them."""
    dot = lambda a, b: np.einsum("ij,ij->j", a, b)
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    x, r = np.zeros_like(right), right.copy()
    first = dot(r, r)
    p, s = r.copy(), product(r)
    before: tuple[np.ndarray, np.ndarray] | None = None
    for step in range(steps):
        size = dot(s, s)
        along = over(dot(r, s), size)
        x, r = x + along * p, r - along * s
        if step + 1 == steps or (dot(r, r) <= enough * enough * first).all():
            break
        new_p, new_s = s, product(s)
        for old_p, old_s in ((p, s), before) if before else ((p, s),):
            back = over(dot(new_s, old_s), dot(old_s, old_s))
            new_p, new_s = new_p - back * old_p, new_s - back * old_s
        before, p, s = (p, s), new_p, new_s
    return x


def orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span ``new`` beside the bases, without what is down to rounding."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        for basis in bases:
            new = new - basis @ (basis.T @ new)
        left, weights, _ = np.linalg.svd(new, full_matrices=False)
        new = left[:, weights > 1e-8]
    return new


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and eigenvectors of a symmetric operator on d dimensions."""
    wanted = min(wanted, d)
    most = min(d, 4 * wanted + EXTRA)
    space = orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, wanted + EXTRA))))
    image = product(space)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    for outer in range(OUTER):
        inside = space.T @ image
        own, turn = np.linalg.eigh((inside + inside.T) / 2)
        own, turn = own[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        largest = max(abs(own[0]) if len(own) else 0.0, *np.abs(values), 0.0)
        open_ = wanted - len(values)
        residual = image[:, :open_] - space[:, :open_] * own[:open_]
        good = np.linalg.norm(residual, axis=0) <= 4 * max(d, 16) * EPS * largest
        # Only a leading run is locked, so none that a later pair could overtake.
        run = len(good) if good.all() else int(np.argmin(good))
        locked, values = np.hstack([locked, space[:, :run]]), np.append(values, own[:run])
        space, image, own, residual, open_ = space[:, run:], image[:, run:], own[run:], residual[:, run:], open_ - run
        if not open_:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if space.shape[1] + open_ > most:  # restart from the best
            kept = min(space.shape[1], open_ + EXTRA)
            space = orthonormal(space[:, :kept] - locked @ (locked.T @ space[:, :kept]))
            image = product(space)
            if space.shape[1] + locked.shape[1] < d:
                inside = space.T @ image
                own, turn = np.linalg.eigh((inside + inside.T) / 2)
                own, turn = own[::-1], turn[:, ::-1]
                space, image = space @ turn, image @ turn
                residual = image[:, :open_] - space[:, :open_] * own[:open_]
        basis = np.hstack([locked, space[:, :open_]])
        beside = lambda t: t - basis @ (basis.T @ t)  # noqa: B023, E731
        shifts = own[:open_]
        shifted = lambda t: beside(product(t) - t * shifts)  # noqa: B023, E731
        corrections = minres(shifted, beside(-residual), INNER, 0.5 ** (outer + 1))
        fresh = orthonormal(np.hstack([corrections, beside(-residual)]) if not outer % 5 else corrections, locked, space)
        fresh = fresh[:, : d - locked.shape[1] - space.shape[1]]
        if fresh.shape[1]:
            space, image = np.hstack([space, fresh]), np.hstack([image, product(fresh)])
        else:  # nothing left to add: what remains is the rounding of the images
            space = orthonormal(space, locked)
            image = product(space)
    raise RuntimeError(f"{wanted - len(values)} of {wanted} eigenpairs did not settle in {OUTER} rounds")


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """The whitening of ``rows(vec_id, x)``; None without rows."""
    ship(rows.sparkSession)
    n = rows.count()
    if not n:
        return None
    d = len(rows.select("x").first()["x"])
    sums = gathered(rows, lambda x: x.sum(axis=0, keepdims=True), (1, d), "long")[0].tolist()
    centred = centring(n, sums)

    def product(p: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ p)

        return gathered(rows, part, p.shape) / n

    trace = float(gathered(rows, lambda x: np.array([[(centred(x) ** 2).sum()]]), (1, 1))[0, 0]) / n
    values, vectors = eigenpairs(product, d, components) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    real = values > max(d, 16) * EPS * values.max(initial=0)
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    if k:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)

    def spread(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ vectors / np.sqrt(values)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    error = 0.0
    if k:
        both = gathered(rows, spread, (k + 1, k)) / n
        error = float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max())
    return Whitening(n, sums, vectors, values, trace, error)


def whitened(vectors: DataFrame, components: int = 32) -> DataFrame:
    """A row for each vector that takes part and each component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = integers(vectors)
    schema = T.StructType(
        [rows.schema["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
         T.StructField("deviation", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]]
    )
    model = fit(rows, components)
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], schema)
    k, n = len(model.eigenvalues), model.n
    centred, axes = centring(n, model.sums), model.components / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if m:
                w = centred(batch.column(1).flatten().to_numpy().reshape(m, -1)) @ axes
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                     batch.column(2).take(each), pa.array(w.ravel()), pa.array(np.tile(explained, m)),
                     pa.array(np.full(m * k, model.identity_error))],
                    names=schema.names,
                )

    gaps = F.zip_with("x", F.array(*[F.lit(s) for s in model.sums]), lambda x, s: F.lit(n) * x - s)
    deviation = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g * g)
    return rows.select("vec_id", "x", deviation.alias("deviation")).mapInArrow(run, schema)
