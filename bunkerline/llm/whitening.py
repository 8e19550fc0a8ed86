"""Whitening of vectors by their principal components, found with a block Jacobi-Davidson iteration.

Rows hold vectors x of integers (long); V is their covariance, divisor n. V is never formed: the iteration only asks for
products V Q with a few columns Q, and each product is one Spark job in which every task centres its rows, (n x - S) / n from
exact integers, multiplies them by Q and by themselves again, and adds up one dims x columns block; blocks meet in a tree.

The driver holds columns only (dims x a few times `components`):

1. Rayleigh-Ritz on the search space gives Ritz pairs and residuals; leading pairs whose residual is at double precision are
   locked and leave the space.
2. For the others the projected correction equations (I - W W')(V - theta)(I - W W') t = -r, W the locked and the current
   Ritz vectors, are solved by a few steps of MINRES, all pairs at once: one product a step.
3. The corrections, orthogonal to everything held, widen the space; beyond `WIDEST` x components it restarts from its best
   Ritz vectors. A space that cannot be widened is everything: what is left is locked.

A last Rayleigh-Ritz on a fresh product polishes the locked pairs. Vectors are signed so that the largest entry is positive.

`valid` drops null and empty vectors and those with entries that are null, not finite or of 2^40 or more (no exact integer
times n is left for those). `whiten` takes the commonest length for the number of dimensions (of equally common ones the longest)
and leaves out rows of others and null vectors. Repeated rows count as often as they stand there; null keys stay. Without rows the
result is empty. Components whose eigenvalue is not above rounding (fewer vectors than dimensions, equal vectors) have null
`whitened` and are left out of `identity_error`, null where all are. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bunkerline.llm.common import stash

#: Residual norms count as converged at this part of the largest eigenvalue.
TOLERANCE = 1e-13
#: MINRES steps of a correction, columns beyond those wanted, widest space as a multiple of the wanted, rounds at most.
STEPS, GUARD, WIDEST, ROUNDS = 6, 8, 4, 200
#: Entries of vectors that are worked on at a time.
ENTRIES = 1 << 20


def valid(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite numbers."""
    return rows.where((F.size(vector) > 0) & F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < 2.0**40, F.lit(False))))


def matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches with their vectors as a matrix of longs."""
    step = max(1, ENTRIES // dims)
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Centred:
    """Sums over a table of vectors `x` of one length."""

    def __init__(self, rows: DataFrame, dims: int):
        self.rows, self.dims = rows, dims
        sums = self.total(lambda x: np.concatenate(([len(x)], x.sum(axis=0))), (dims + 1,), np.int64)
        self.n, self.sums = int(sums[0]), sums[1:]

    def total(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: type = np.float64) -> np.ndarray:
        """The sum of `of(matrix)` over all vectors: one block a task, blocks added in a tree."""
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, kind)
            for _, x in matrices(batches, dims):
                total += of(x)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        blocks = self.rows.select("x").mapInArrow(run, "total binary").rdd.map(lambda r: np.frombuffer(r[0], kind).reshape(shape))
        return blocks.treeReduce(np.add, depth=2)

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        n, sums = self.n, self.sums
        return lambda x: (n * x - sums) / n

    def multiply(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times some columns, without the covariance."""
        centre = self.centre()

        def of(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ columns)

        return self.total(of, columns.shape) / self.n


def minres(multiply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """A few MINRES steps for each column of b at once, from zero."""
    tiny = np.finfo(float).tiny
    over = lambda a, c: np.divide(a, c, out=np.zeros(np.broadcast(a, c).shape), where=np.abs(c) > tiny)
    m = b.shape[1]
    phi = np.linalg.norm(b, axis=0)
    v, before = over(b, phi), np.zeros_like(b)
    w, w_before, x = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    beta, bar, eps, cos, sin = np.zeros(m), np.zeros(m), np.zeros(m), -np.ones(m), np.zeros(m)
    for _ in range(steps):
        z = multiply(v) - beta * before
        alpha = (v * z).sum(axis=0)
        z -= alpha * v
        beta = np.linalg.norm(z, axis=0)
        eps_before, delta, gbar = eps, cos * bar + sin * alpha, sin * bar - cos * alpha
        eps, bar = sin * beta, -cos * beta
        gamma = np.hypot(gbar, beta)
        cos, sin = over(gbar, gamma), over(beta, gamma)
        w, w_before = over(v - eps_before * w_before - delta * w, gamma), w
        x += cos * phi * w
        phi = sin * phi
        before, v = v, over(z, beta)
    return x


def _orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns add to an orthonormal set; directions that are only rounding go."""
    norms = np.linalg.norm(columns, axis=0)
    columns = columns[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        columns = columns - against @ (against.T @ columns)
    left, size, _ = np.linalg.svd(columns, full_matrices=False)
    new = left[:, size > 1e-8]
    for _ in range(2):
        new = np.linalg.qr(new - against @ (against.T @ new))[0]
    return new


def eigenpairs(multiply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric positive operator, falling, and unit eigenvectors as columns."""
    wanted = min(wanted, dims)
    width = min(dims, wanted + GUARD)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    space = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    image = multiply(space)
    for _ in range(ROUNDS):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        open_ = wanted - len(values)
        rest = image[:, :open_] - space[:, :open_] * theta[:open_]
        rest -= locked @ (locked.T @ rest)
        scale = max(theta[0], values.max(initial=0))
        good = np.linalg.norm(rest, axis=0) <= TOLERANCE * scale
        done = len(good) if good.all() or len(values) + space.shape[1] == dims else int(np.argmin(good))
        locked, values = np.hstack((locked, space[:, :done])), np.append(values, theta[:done])
        space, image, theta, rest = space[:, done:], image[:, done:], theta[done:], rest[:, done:]
        open_ -= done
        if not open_:
            break
        if space.shape[1] > WIDEST * wanted:
            space, image = space[:, : open_ + GUARD], image[:, : open_ + GUARD]
        held, shift = np.hstack((locked, space[:, :open_])), theta[:open_]

        def corrected(t: np.ndarray) -> np.ndarray:
            t = t - held @ (held.T @ t)
            out = multiply(t) - shift * t
            return out - held @ (held.T @ out)

        more = minres(corrected, -(rest - held @ (held.T @ rest)), STEPS)
        more = _orthonormal(more, np.hstack((locked, space)))
        if not more.shape[1]:  # the corrections are rounding: go on from random directions
            more = _orthonormal(np.random.default_rng(seed + 1).standard_normal((dims, open_)), np.hstack((locked, space)))
        space, image = np.hstack((space, more)), np.hstack((image, multiply(more)))
    else:
        raise RuntimeError(f"{wanted - len(values)} of {wanted} eigenpairs have not converged")
    small = locked.T @ multiply(locked)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    vectors = locked @ turn[:, ::-1]
    return values[::-1], vectors * np.where(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(wanted)] < 0, -1.0, 1.0)


def _deviations(d: np.ndarray) -> pa.Array:
    """Exact sums of squares of rows of longs."""
    most = int(np.abs(d).max(initial=0))
    if most * most * d.shape[1] < 1 << 63:
        return pa.array((d * d).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    from decimal import Decimal

    return pa.array([Decimal(s) for s in (d.astype(object) ** 2).sum(axis=1)], pa.decimal128(38, 0))


def whiten(rows: DataFrame, vector: str, components: int = 32, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, component, n, deviation, whitened, explained, identity_error) of every vector of longs and component, from 1.

    deviation is n^2 times the squared distance from the mean, exact; whitened is the projection over the root of the eigenvalue.
    """
    names = [f"keep_{i}" for i in range(len(keep))]
    kinds = [rows.schema[c].dataType.simpleString() for c in keep]
    stored = stash(rows.where(F.col(vector).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(vector).cast("array<long>").alias("x")))
    lengths = stored.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = lengths[0]["dims"] if lengths else 0
    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"])
    if not dims:
        out = stored.limit(0).select(*names, *[F.lit(None).cast(k).alias(c) for c, k in (("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
        return out.withColumnsRenamed(dict(zip(names, keep)))
    stored = stored.where(F.size("x") == dims)
    table = Centred(stored, dims)
    n, sums, centre = table.n, table.sums, table.centre()
    trace = float(table.total(lambda x: (centre(x) ** 2).sum(axis=0), (dims,)).sum()) / n
    if trace > 0:
        values, vectors = eigenpairs(table.multiply, dims, components)
    else:
        values, vectors = np.zeros(min(components, dims)), np.eye(dims)[:, : min(components, dims)]
    k = len(values)
    known = values > dims * np.finfo(float).eps * max(values[0], 0.0)
    turn = vectors * np.where(known, 1 / np.sqrt(np.where(known, values, 1.0)), 0.0)
    mean = table.total(lambda x: (centre(x) @ turn).sum(axis=0), (k,)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ turn - mean
        return w.T @ w

    off = np.abs(table.total(spread, (k, k)) / n - np.eye(k))[np.ix_(known, known)]
    error = float(off.max()) if off.size else None
    explained = [float(v) / trace if trace > 0 else None for v in values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, dims):
            each = pa.array(np.repeat(np.arange(len(x)), k))
            whitened = pa.array((centre(x) @ turn).ravel(), mask=np.tile(~known, len(x)))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).take(each) for c in names), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)),
                _deviations(n * x - sums).take(each), whitened, pa.array(explained, pa.float64()).take(pa.array(np.tile(np.arange(k), len(x)))), pa.array([error], pa.float64()).take(pa.array(np.zeros(len(each), np.int64))),
            ], [*names, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return stored.mapInArrow(project, schema).withColumnsRenamed(dict(zip(names, keep)))
