"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed.  Every step is a pass over the stored integer vectors that multiplies the
centred vectors with a narrow block Q and adds up ``Xt (X Q) / n``: a task sends that small matrix cell by cell, Spark adds
the cells, the driver gets a matrix as narrow as Q.  A polynomial recurrence over such passes damps the part of the
spectrum below the block's smallest Ritz value, QR and Rayleigh-Ritz follow, and the loop ends when the residuals of all
wanted components certify them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpmine.llm.common import pieces
from dpmine.llm.vector_codes import is_whole
from dpmine.session import materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
GUARD = 16                 # block columns beyond the wanted ones
DEGREE = 8                 # of the filter polynomial: passes between two orthogonalisations
CERTIFIED = 1e-13          # residual of a component over the largest eigenvalue
STALLED = 1e-10            # accepted where rounding keeps the residual from falling further
LARGEST = 1 << 40          # of an integer component
MAX_ROUNDS = 200
NULL_SPACE = 1e-13         # eigenvalues under this share of the largest count as zero


def integers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """``floor(scale * c) + offset`` of every component, c as double."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(offset).cast("long"))


@dataclass
class Fit:
    """What the fit list gives: number of vectors, exact sums, unit components by falling eigenvalue, trace of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray        # a column for each component
    values: np.ndarray
    trace: float
    residuals: np.ndarray      # |V q - e q| over the largest eigenvalue


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - S`` as whole numbers; they must fit 63 bits."""
    if float(np.abs(x).max(initial=0)) * n + float(np.abs(sums).max(initial=0)) >= 2 ** 62:
        raise OverflowError("n times a component does not fit a long")
    return x * n - sums


def _added(rows: DataFrame, width: int, kind: str, of_batch) -> np.ndarray:
    """The sum over all batches of the ``dimensions x width`` matrices that ``of_batch(vectors)`` gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in pieces(batches):
            part = of_batch(_matrix(batch.column("vec")))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(range(total.size), pa.int32()), "value": pa.array(total.ravel())})

    found = rows.select("vec").mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    cells = found.toArrow()                                         # dimensions x width numbers
    at, values = cells.column("cell").to_numpy(), cells.column("value").to_numpy()
    total = np.zeros(len(at), np.int64 if kind == "long" else np.float64)
    total[at] = values
    return total.reshape(-1, width)


def multiply(rows: DataFrame, n: int, sums: np.ndarray, block: np.ndarray) -> np.ndarray:
    """``V block`` for the covariance V of all rows, in one pass; V itself is not formed."""
    def of_batch(x: np.ndarray) -> np.ndarray:
        z = _centred(x, n, sums) / n
        return z.T @ (z @ block)
    return _added(rows, block.shape[1], "double", of_batch) / n


def _ritz(block: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz in the span of an orthonormal ``block``: values (falling), vectors and the images of the vectors."""
    h = block.T @ image
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], block @ turn, image @ turn


def fit(rows: DataFrame, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, seed: int = 7) -> Fit | None:
    """Leading components of stored ``vec`` rows (integer vectors of one length); None for an empty table.

    Driver and tasks hold blocks of ``dimensions x (components + guard)`` numbers.  Fewer components come back where the
    covariance has a lower rank.
    """
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"), F.min(F.size("vec")).alias("least")).first()
    n, d = about["n"], about["d"]
    if not n:
        return None
    if d != about["least"]:
        raise ValueError("vectors with different numbers of components")
    sums = _added(rows, 1, "long", lambda x: x.sum(axis=0)[:, None])[:, 0]

    def squares(x: np.ndarray) -> np.ndarray:
        z = _centred(x, n, sums) / n
        return (z * z).sum(axis=0)[:, None]
    trace = float(_added(rows, 1, "double", squares).sum() / n)
    if not trace:
        return Fit(n, [int(s) for s in sums], np.zeros((d, 0)), np.zeros(0), 0.0, np.zeros(0))

    m = min(d, components + guard)
    block, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))
    if m == d:
        block = np.eye(d)                          # nothing is left to damp: one Rayleigh-Ritz step is exact
    values, vectors, images = _ritz(block, multiply(rows, n, sums, block))
    wanted, last = min(components, d), np.inf
    # where the spectrum begins: a random block's smallest Ritz value less its residual, given up if it does not serve
    low = max(0.0, float(values[-1] - np.linalg.norm(images[:, -1] - vectors[:, -1] * values[-1])))
    for _ in range(MAX_ROUNDS):
        top = values[0]
        residuals = np.linalg.norm(images - vectors * values, axis=0)[:wanted] / top
        worst = float(residuals.max())
        if m == d or worst <= CERTIFIED or (worst <= STALLED and worst > last / 2):
            break
        low = low if worst < last / 2 else 0.0
        last = worst
        # the unwanted interval [low, high] maps to [-1, 1]; the recurrence is scaled by its value at the largest Ritz value
        high = max(values[-1], top * 1e-12)
        low = min(low, high / 2) if high - low < high / 100 else low
        centre, half = (high + low) / 2, (high - low) / 2
        sigma = first = half / (centre - top)
        before, now = vectors, (images - centre * vectors) * (sigma / half)
        for _ in range(2, degree + 1):
            following = 1 / (2 / first - sigma)
            image = multiply(rows, n, sums, now)
            before, now = now, (image - centre * now) * (2 * following / half) - before * (sigma * following)
            sigma = following
        block, _ = np.linalg.qr(now)
        values, vectors, images = _ritz(block, multiply(rows, n, sums, block))
    else:
        raise ArithmeticError(f"components not certified: residual {worst:.3g} of the largest eigenvalue")
    keep = int((values[:wanted] > values[0] * NULL_SPACE * d).sum())
    vectors = vectors[:, :keep] / np.linalg.norm(vectors[:, :keep], axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(keep)])
    return Fit(n, [int(s) for s in sums], vectors * signs, values[:keep].copy(), trace, residuals[:keep])


def _projected(x: np.ndarray, found: Fit, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S, whitened components) of a batch."""
    z = _centred(x, found.n, sums)
    return z, (z / found.n) @ (found.vectors / np.sqrt(found.values))


def identity_error(rows: DataFrame, found: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from two passes over them."""
    k, sums = len(found.values), np.array(found.sums, np.int64)
    mean = _added(rows, 1, "double", lambda x: _projected(x, found, sums)[1].sum(axis=0)[:, None])[:, 0] / found.n

    def of_batch(x: np.ndarray) -> np.ndarray:
        w = _projected(x, found, sums)[1] - mean
        return w.T @ w
    return float(np.abs(_added(rows, k, "double", of_batch) / found.n - np.eye(k)).max(initial=0))


def integer_rows(vectors: DataFrame, key: str, vector: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``id, vec`` of the rows whose vector is whole, stored; components out of range are an error."""
    v = integers(F.col(vector), scale, offset)
    vec = F.when(F.exists(v, lambda x: F.abs(x) > LARGEST), F.raise_error(F.lit(
        f"a component is beyond {LARGEST} after scaling"))).otherwise(v)
    return materialize(vectors.filter(is_whole(F.col(vector))).select(F.col(key).cast("long").alias("id"), vec.alias("vec")),
                       "vectors")


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each whole vector and component.

    Vectors that are null, empty or hold a null, NaN or infinite component are dropped; rows with a null id and repeated
    rows take part, each for itself (in the fit too).  Components whose eigenvalue is zero to rounding have no whitened
    value and are left out, so equal vectors only (or a single one) and an empty table give no row.  Equal eigenvalues
    have one orthonormal choice of components for all rows.  Vectors of different lengths, components beyond ``LARGEST``
    after scaling and deviations beyond a long are errors.  Other columns of the table play no part.
    """
    rows = integer_rows(vectors, key, vector, scale, offset)
    found = fit(rows, components)
    schema = ("id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], schema)
    sums, k, error = np.array(found.sums, np.int64), len(found.values), identity_error(rows, found)
    explained = found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):                    # a row becomes ``components`` rows
            z, w = _projected(_matrix(batch.column("vec")), found, sums)
            if (z.astype(np.float64) ** 2).sum(axis=1).max() >= 2 ** 63:
                raise OverflowError("a deviation does not fit a long")
            deviation = (z * z).sum(axis=1)
            at = pa.array(np.repeat(np.arange(len(z)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))),
                pa.array(np.full(len(at), found.n)), pa.array(np.repeat(deviation, k)), pa.array(w.ravel()),
                pa.array(np.tile(explained, len(z))), pa.array(np.full(len(at), error))], names=[
                    "id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, schema)
