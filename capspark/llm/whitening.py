"""Whitening components of embeddings by shifted CholeskyQR.

Entries become whole numbers, so counts, sums and centring are exact. Each pass is one job: every
task solves its centred rows against the triangular factors so far and adds up the Gram matrix of
the result; only the sum over all tasks, one number for each pair of dimensions, comes to the
driver, whose Cholesky factor is the next one. The first factor is of a shifted Gram matrix, so that
it exists however ill conditioned the rows are; the next passes make the rows orthogonal to double
precision. The SVD of the composed factor gives the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capspark.llm.session import bound_batches

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Gram passes at most; three are enough unless some dimensions depend on others.
PASSES = 5
#: Largest distance from the identity at which the rows count as orthogonal.
ORTHOGONAL = 1e-12
#: Components with less than this share of the largest eigenvalue are noise of rounding.
LEAST_EIGENVALUE = 1e-20
_HALF = 1 << 26
_LIMIT = 1 << 52
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """n rows; quotient and rest of the sums by n; components as columns; eigenvalues; their total."""

    n: int
    quotient: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    total: float


def usable(vectors: DataFrame, col: str) -> DataFrame:
    """The rows whose vector has entries, all of them finite."""
    finite = F.forall(F.col(col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(col).isNotNull() & (F.size(col) > 0) & finite)


def fixed_point(column: pa.Array) -> np.ndarray:
    """floor(SCALE * entry) + OFFSET of a column of vectors, a row each; beyond 2^52 it stays there."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(flat * SCALE), -_LIMIT, _LIMIT).astype(np.int64)
    return (whole + OFFSET).reshape(len(column), -1)


def _solved(y: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The rows z with z @ factor = y, for an upper triangular factor, column after column."""
    z = np.empty_like(y)
    for j in range(y.shape[1]):
        z[:, j] = (y[:, j] - z[:, :j] @ factor[:j, j]) / factor[j, j]
    return z


def _sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dim + 1)
        for b in batches:
            x = fixed_point(b.column(0))
            low = x % _HALF
            for i, (h, l) in enumerate(zip(((x - low) // _HALF).sum(axis=0).tolist(), low.sum(axis=0).tolist(), strict=True)):
                total[i] += h * _HALF + l
            total[dim] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["i", "s"])

    got = {r["i"]: int(r["s"]) for r in rows.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return got.get(dim, 0), [got.get(i, 0) for i in range(dim)]


def _gram(rows: DataFrame, size: int, shape: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The Gram matrix of the rows that shape() makes of the fixed-point ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            if b.num_rows:
                z = shape(fixed_point(b.column(0)))
                total += z.T @ z
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    out = np.zeros((size, size))
    for r in rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _centred(x: np.ndarray, n: int, quotient: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - quotient).astype(np.float64) - rest / n


def fit(vectors: DataFrame, col: str, most: int = COMPONENTS) -> Whitening | None:
    """The components of the vectors in col; None if no row is usable. Vectors are those of usable();
    of vectors of several lengths the commonest count (of equals the shortest)."""
    dims = vectors.groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    if not dims:
        return None
    dim = dims[0]["d"]
    rows = vectors.filter(F.size(col) == dim).select(F.col(col).cast("array<double>").alias("v"))
    n, sums = _sums(rows, dim)
    quotient, rest = (np.array([f(s, n) for s in sums], np.int64) for f in (lambda s, n: s // n, lambda s, n: s % n))

    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        z = _centred(x, n, quotient, rest)
        for r in factors:
            z = _solved(z, r)
        return z

    gram = _gram(rows, dim, orthogonal)
    composed = np.eye(dim)
    while len(factors) < PASSES and gram.any() and np.abs(gram - np.eye(dim)).max() > ORTHOGONAL:
        shift = 11 * (n * dim + dim * (dim + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
        try:
            if not factors:
                raise np.linalg.LinAlgError
            factor = np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:  # the first one, or some dimensions depend on others
            factor = np.linalg.cholesky(gram + shift * np.eye(dim)).T
        factors.append(factor)
        composed = factor @ composed
        gram = _gram(rows, dim, orthogonal)
    # gram is the identity, but where the rows have less than full rank
    e, v = np.linalg.eigh(gram)
    _, s, w = np.linalg.svd((v * np.sqrt(np.maximum(e, 0))) @ v.T @ composed)
    eigenvalues = s**2 / n
    keep = int((eigenvalues[:most] > LEAST_EIGENVALUE * eigenvalues[0]).sum())
    components = w[:keep].T
    components = components * np.where(components[np.abs(components).argmax(axis=0), np.arange(keep)] < 0, -1.0, 1.0)
    return Whitening(n, quotient, rest, components, eigenvalues[:keep], float(eigenvalues.sum()))


def _whitened(m: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    n, quotient, rest, to = m.n, m.quotient, m.rest, m.components / np.sqrt(m.eigenvalues)
    return lambda x: _centred(x, n, quotient, rest) @ to


def identity_error(vectors: DataFrame, col: str, m: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by one more pass."""
    white, k = _whitened(m), len(m.eigenvalues)
    rows = vectors.filter(F.size(col) == len(m.quotient)).select(F.col(col).cast("array<double>").alias("v"))
    return float(np.abs(_gram(rows, k, white) / m.n - np.eye(k)).max(initial=0))


def _deviations(x: np.ndarray, m: Whitening) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2 of each row, exactly; None where it is no long."""
    apart = x - m.quotient
    most = int(np.abs(apart).max(initial=0)) + 1
    if (m.n * most) ** 2 * x.shape[1] < _LONG:
        return ((m.n * apart - m.rest) ** 2).sum(axis=1).tolist()
    about = ((m.n * _centred(x, m.n, m.quotient, m.rest)) ** 2).sum(axis=1)
    out: list[int | None] = [None] * len(x)
    for i in np.flatnonzero(about < 1.01 * _LONG).tolist():
        exact = sum((m.n * a - r) ** 2 for a, r in zip(apart[i].tolist(), m.rest.tolist(), strict=True))
        out[i] = exact if exact <= _LONG else None
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """For every usable row and component: id_col, component (from 1 by falling eigenvalue), n,
    deviation, whitened (x - S/n projected on the component, over the root of its eigenvalue),
    explained (its share of all variance) and identity_error, one value for all rows.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out, and of vectors
    of several lengths all but the commonest length. Components without variance are left out, so
    equal vectors, a single one or an empty table give no rows. Ids may repeat or be null: each row
    counts. deviation is null where it exceeds a long, entries beyond 2^42 count as 2^42. A
    component's largest entry is positive. Other columns are left out, whatever their names.
    """
    bound_batches(vectors.sparkSession)
    rows = usable(vectors.select(F.col(id_col).alias("__id"), F.col(col).alias("__v")), "__v")
    m = fit(rows, "__v", most)
    schema = "deviation long, w array<double>"
    if m is None:
        m = Whitening(0, np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 0)), np.empty(0), 0.0)
    k = len(m.eigenvalues)
    error = identity_error(rows, "__v", m) if k else 0.0
    white = _whitened(m)

    def make(column: pa.Array) -> pa.Array:
        if not k or not len(column):
            return pa.array([None] * len(column), pa.struct([("deviation", pa.int64()), ("w", pa.list_(pa.float64()))]))
        x = fixed_point(column)
        ends = np.arange(0, k * len(x) + 1, k, dtype=np.int32)
        return pa.StructArray.from_arrays([pa.array(_deviations(x, m), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(white(x).ravel()))], names=["deviation", "w"])

    made = rows.filter(F.size("__v") == len(m.quotient)).select("__id", F.arrow_udf(make, schema)(F.col("__v").cast("array<double>")).alias("m"))
    explained = F.array(*[F.lit(float(e / m.total)) for e in m.eigenvalues]) if k else F.array().cast("array<double>")
    out = made.select("__id", F.col("m.deviation").alias("deviation"), F.posexplode("m.w").alias("at", "whitened"))
    return out.select(
        F.col("__id").alias(id_col),
        (F.col("at") + 1).alias("component"),
        F.lit(m.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
