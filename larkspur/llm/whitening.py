"""Embedding whitening by a block Jacobi-Davidson method over distributed products.

Vectors become whole numbers x = floor(1024 c) + 100000.  Their covariance V is never
formed: a product of V with a few directions is one job, in which every task centres its
rows exactly, multiplies them by the directions and hands on one small sum; sums are
added in two levels, so the driver gets the square root of the number of tasks of them.

The driver holds a subspace of at most ``WIDTH`` directions (numbers of the dimension,
not of the rows) and repeats: Rayleigh-Ritz in the subspace; pairs whose residual has
reached double precision are locked (they stay in the subspace and ask for no more
corrections); for every other wanted pair the correction equation, projected against
the locked pairs and the pair itself, is solved by a few steps of MINRES, all pairs
sharing each product; the corrections extend the subspace.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries go, and
so do vectors of another length than the most frequent one (the longest of ties; empty
vectors are no vectors); whole numbers beyond 2^52 are held there, so that all centred
numbers are exact as far as a double goes; repeated rows and ids count and are returned
as often as they occur; a null ``vec_id`` stays null; components without variance (as
where all vectors are equal) are not returned; a deviation that does not fit a long is
null; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import staged

COMPONENTS = 8
#: Directions of the subspace before it is restarted from its best ones.
WIDTH = 48
#: Largest residual of a locked pair, against the largest eigenvalue.
TOLERANCE = 2e-15
#: MINRES steps of a correction, and what it leaves of a residual at most.
STEPS, LEFT = 3, 0.05
ROUNDS, SEED = 60, 11
LIMIT = 1 << 52


@dataclass(frozen=True)
class Model:
    """What whitens: counts, sums and trace of the fit list, eigenvalues, directions (columns)."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    directions: np.ndarray


def whole_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors as longs, without those that are not finite."""
    entry = lambda c: c.cast("double")
    fine = F.col(column).isNotNull() & F.forall(column, lambda c: F.coalesce(~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")), F.lit(False)))
    held = lambda c: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), 1024 * entry(c)))
    x = F.transform(column, lambda c: F.floor(held(c)) + 100_000)
    return vectors.where(fine & (F.size(column) > 0)).select(F.col(key).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _added(parts: DataFrame, shape: tuple[int, ...], kind: str) -> np.ndarray:
    """Sum of the column ``part`` (arrays as bytes), one row a task, in two levels."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("part").to_pylist():
                one = np.frombuffer(raw, kind)
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    groups = max(1, math.isqrt(parts.rdd.getNumPartitions()))
    out = np.zeros(shape, kind)
    for row in parts.repartition(groups).mapInArrow(add, "part binary").collect():
        out += np.frombuffer(row.part, kind).reshape(shape)
    return out


def _summed(table: DataFrame, shape: tuple[int, ...], kind: str, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``of(rows)`` over all batches of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column("x")))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return _added(table.select("x").mapInArrow(run, "part binary"), shape, kind)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S as whole numbers: exact, by Python's numbers where 64 bits don't hold them."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, sums.tolist()), default=0) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _orthonormal(basis: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What ``new`` adds to ``basis``, as orthonormal columns; what is in it already goes."""
    kept = []
    for column in new.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        column = column / size
        for _ in range(3):
            column = column - basis @ (basis.T @ column)
            for other in kept:
                column = column - other * (other @ column)
            size = np.linalg.norm(column)
            if size < 1e-8:
                break
            column = column / size
        else:
            kept.append(column)
    return np.array(kept).T.reshape(len(new), len(kept))


def _corrections(product, theta: np.ndarray, against: list[np.ndarray], residual: np.ndarray, steps: int, left: float) -> np.ndarray:
    """MINRES on (1 - UU')(V - theta)(1 - UU') t = -r, a column a pair; a step is one product."""

    def project(m):
        return np.stack([m[:, i] - u @ (u.T @ m[:, i]) for i, u in enumerate(against)], axis=1)

    t = np.zeros_like(residual)
    v = project(-residual)
    beta = first = np.linalg.norm(v, axis=0)
    safe = lambda a: np.where(a > 0, a, 1.0)
    v = v / safe(beta)
    old, w0, w1 = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    eta, c0, c1, s0, s1 = beta.copy(), np.ones(len(beta)), np.ones(len(beta)), np.zeros(len(beta)), np.zeros(len(beta))
    for _ in range(steps):
        q = project(product(v) - theta * v)
        alpha = (v * q).sum(axis=0)
        q = q - alpha * v - beta * old
        grown = np.linalg.norm(q, axis=0)
        delta = c1 * alpha - c0 * s1 * beta
        r1, r2, r3 = safe(np.hypot(delta, grown)), s1 * alpha + c0 * c1 * beta, s0 * beta
        c0, c1, s0, s1 = c1, delta / r1, s1, grown / r1
        w0, w1 = w1, (v - r3 * w0 - r2 * w1) / r1
        t = t + c1 * eta * w1
        eta = -s1 * eta
        old, v, beta = v, q / safe(grown), grown
        if (np.abs(eta) <= left * first).all():
            break
    return project(t)


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, width: int = WIDTH, tolerance: float = TOLERANCE, steps: int = STEPS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors (columns) of the
    symmetric matrix that ``product`` multiplies by.

    Ends when all residuals are within ``tolerance`` or, as a product's own rounding may
    lie above that, when they have stopped falling near it; else raises.
    """
    wanted, width = min(wanted, size), min(size, max(width, 3 * wanted))
    rng = np.random.default_rng(SEED)
    basis = _orthonormal(np.zeros((size, 0)), rng.standard_normal((size, min(size, 2 * wanted))))
    image, best, stuck = product(basis), np.inf, 0
    for _ in range(rounds):
        inner = basis.T @ image
        theta, y = np.linalg.eigh((inner + inner.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        pairs, images = basis @ y[:, :wanted], image @ y[:, :wanted]
        residual = images - pairs * theta[:wanted]
        norm = np.linalg.norm(residual, axis=0)
        scale = max(theta[0], 0.0)
        worst = norm.max(initial=0.0)
        stuck = 0 if worst < best / 2 else stuck + 1
        best = min(best, worst)
        if worst <= tolerance * scale or scale == 0 or stuck >= 2 and worst <= 100 * tolerance * scale:
            return theta[:wanted], pairs
        if basis.shape[1] + wanted > width and basis.shape[1] > 2 * wanted:  # restart from the best directions
            keep = min(2 * wanted, basis.shape[1])
            basis = _orthonormal(np.zeros((size, 0)), basis @ y[:, :keep])
            image = product(basis)
            continue
        locked = norm <= tolerance * scale
        open_ = np.flatnonzero(~locked)
        against = [np.column_stack([pairs[:, locked], pairs[:, [i]]]) for i in open_]
        found = _corrections(product, theta[open_], against, residual[:, open_], steps, LEFT)
        new = _orthonormal(basis, np.column_stack([found, residual[:, open_]])[:, : max(1, width - basis.shape[1])])
        if not new.shape[1]:  # the whole space, or rounding alone is left
            new = _orthonormal(basis, rng.standard_normal((size, wanted)))
            if not new.shape[1]:
                return theta[:wanted], pairs
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    raise ArithmeticError(f"residuals of {worst:.3g} after {rounds} rounds, against an eigenvalue of {scale:.3g}")


def fit(whole: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Model]:
    """The rows of staged ``whole_vectors`` of the most frequent length, and their model."""
    lengths = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    size, n = lengths[0] if lengths else (0, 0)
    rows = whole.where(F.size("x") == size)
    if not n:
        return rows, Model(0, np.zeros(0, object), 0.0, np.zeros(0), np.zeros((0, 0)))
    wide = 1 << 20  # sums of halves, so that no count of rows overflows them
    halves = _summed(rows, (2, size), "<i8", lambda x: np.stack([(x // wide).sum(axis=0), (x % wide).sum(axis=0)]))
    sums = halves[0].astype(object) * wide + halves[1].astype(object)

    def product(b: np.ndarray) -> np.ndarray:
        def of(x):
            z = centred(x, n, sums).astype(float) / n
            return z.T @ (z @ b)

        return _summed(rows, b.shape, "<f8", of) / n

    squares = _summed(rows, (size,), "<f8", lambda x: ((centred(x, n, sums).astype(float) / n) ** 2).sum(axis=0))
    trace = float(squares.sum()) / n
    values, directions = eigenpairs(product, size, components) if trace > 0 else (np.zeros(0), np.zeros((size, 0)))
    real = values > 1e-12 * trace
    return rows, Model(n, sums, trace, values[real], directions[:, real])


def _projected(x: np.ndarray, m: Model) -> np.ndarray:
    return (centred(x, m.n, m.sums).astype(float) / m.n) @ m.directions / np.sqrt(m.values)


def identity_error(rows: DataFrame, m: Model) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = len(m.values)
    mean = _summed(rows, (k,), "<f8", lambda x: _projected(x, m).sum(axis=0)) / m.n

    def of(x):
        w = _projected(x, m) - mean
        return w.T @ w

    return float(np.abs(_summed(rows, (k, k), "<f8", of) / m.n - np.eye(k)).max(initial=0.0))


def whitened(rows: DataFrame, m: Model) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained) for every row and component."""
    k = len(m.values)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                x = _matrix(piece.column("x"))
                far = centred(x, m.n, m.sums)
                if far.dtype != object and len(far[0]) * int(np.abs(far).max()) ** 2 >= 1 << 63:
                    far = far.astype(object)
                deviation = (far**2).sum(axis=1).tolist()
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    piece.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), m.n)),
                    pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64()).take(pa.array(each)), pa.array(_projected(x, m).ravel()), pa.array(np.tile(m.values / m.trace, len(x))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double"
    return (rows if k else rows.limit(0)).mapInArrow(run, schema)


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``whitened`` rows of ``vectors`` by their own model, with ``identity_error``."""
    rows, model = fit(staged(whole_vectors(vectors, key, column), "whole-vectors"), components)
    return whitened(rows, model).withColumn("identity_error", F.lit(identity_error(rows, model) if len(model.values) else 0.0))
