"""Operator 12: whitening of embeddings by spectral divide and conquer with QDWH polar decompositions.

The covariance of the distinct vectors is summed by Spark, a partial matrix a task. Its leading components are found on the driver, whose matrices have the size of the dimensions
alone: the polar factor U of A - s I is found by dynamically weighted Halley iterations; (U + I) / 2 projects on the subspace of eigenvalues above s; its basis and
that of its complement split A in two, and both go on until single components are left. Where only leading components are wanted, lower parts aren't split.
The projection then goes out to all rows in a broadcast of dimensions x components numbers.

Entries are whole numbers (floor of 256 times the entry), so sums, and what depends on them alone, are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SCALE = 256
#: Vectors of more entries are an error: the driver holds a few matrices of this size squared.
MOST_DIMENSIONS = 1024
#: Components whose share of the variance is no more than this are rounding errors, and left out.
LEAST_SHARE = 1e-12
#: Halley steps: seven do from a smallest singular value of 1e-16 on. QR steps are needed for weights above WEIGHT, else Cholesky does.
MOST_STEPS, WEIGHT = 20, 100.0


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix, by QDWH. Raises LinAlgError where the matrix is singular."""
    n = len(a)
    x = a / np.sqrt(np.linalg.norm(a, 1) * np.linalg.norm(a, np.inf))
    eye = np.eye(n)
    low = 1 / (np.sqrt(n) * np.linalg.norm(np.linalg.inv(x), 1))  # below the smallest singular value
    if not low > 0:
        raise np.linalg.LinAlgError("singular")
    low = min(1.0, low)
    for _ in range(MOST_STEPS):
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        before = x
        if r > WEIGHT:
            basis = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))[0]
            x = q / r * x + (p - q / r) / np.sqrt(r) * basis[:n] @ basis[n:].T
        else:
            half = np.linalg.cholesky(eye + r * x.T @ x)
            x = q / r * x + (p - q / r) * np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        if 1 - low < 1e-14 and np.linalg.norm(x - before) <= 1e-5 * np.sqrt(n):
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis, and how many of its first columns span the subspace of the larger eigenvalues; the others span the rest. None where rounding leaves nothing to split.

    The shift is the diagonal's median. A shift on an eigenvalue, or outside all, doesn't split cleanly: others are tried then, and the cleanest split counts.
    """
    n, diagonal = len(a), np.diag(a)
    mean, spread = diagonal.mean(), np.linalg.norm(a - np.eye(n) * diagonal.mean()) / np.sqrt(n)
    rng, best = np.random.default_rng(n), None
    for shift in [np.median(diagonal), mean, *(mean + f * spread for f in (0.1, -0.1, 0.37, -0.37, 0.71, -0.71, 0.03, -0.03))]:
        try:
            u = polar_factor(a - shift * np.eye(n))
        except np.linalg.LinAlgError:
            continue
        projector = (u + u.T) / 4 + np.eye(n) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        basis = rng.standard_normal((n, k))
        for _ in range(2):
            basis = np.linalg.qr(projector @ basis[:, :k], mode="complete")[0]
        left = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or left < best[0]:
            best = left, basis, k
        if left <= 1e-14 * n * np.linalg.norm(a):
            break
    return best and best[1:]


def spectrum(a: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns; the leading ones where not all are wanted."""
    n = len(a)
    wanted = n if wanted is None else min(n, wanted)
    if not wanted:
        return np.empty(0), np.empty((n, 0))
    mean = np.trace(a) / n
    if n == 1 or np.linalg.norm(a - mean * np.eye(n)) <= 4e-16 * n * np.linalg.norm(a):
        return np.full(wanted, mean), np.eye(n)[:, :wanted]
    parts = split(a)
    if parts is None:
        return np.full(wanted, mean), np.eye(n)[:, :wanted]
    basis, k = parts
    values, vectors = [], []
    for part in (basis[:, :k], basis[:, k:]):
        inner = part.T @ a @ part
        e, v = spectrum((inner + inner.T) / 2, wanted - sum(map(len, values)))
        values.append(e)
        vectors.append(part @ v)
    values, vectors = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors, their sums by dimension, eigenvalues and unit components (columns) of their covariance, its trace, and how far the whitened covariance is from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0


def whole(column: Column, dimensions: int | None = None) -> Column:
    """The whole numbers of an array's entries, filled up with zeros; null for a null array, or one with a null or non-finite entry. What passes the longs is the last long."""
    odd = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(column, lambda c: F.floor(SCALE * c.cast("double")))
    filled = x if dimensions is None else F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dimensions) - F.size(x)))
    return F.when(~odd, filled)


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit numbers, or Python's where those would overflow."""
    most = max([0, int(x.max()), -int(x.min())]) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < 1 << 63:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _vectors(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(fit: DataFrame, each, d: int, kind: str, shape: int) -> np.ndarray:
    """Sums over all of fit's batches of each(vectors), a matrix of d x shape, from a partial one a task. kind is double or decimal(38,0)."""

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in common.short(batches):
            if batch.num_rows:
                part = each(_vectors(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.divmod(np.arange(total.size), shape)
            values = pa.array(total.ravel(), pa.float64()) if kind == "double" else pa.array(total.ravel().tolist(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], ["i", "j", "v"])

    parts = fit.coalesce(int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, f"i int, j int, v {kind}")
    rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v")))["v"].alias("v")).collect()  # d rows
    return np.array([r["v"] for r in sorted(rows)], object if kind != "double" else float).reshape(len(rows), shape)


def fit(rows: DataFrame, components: int, column: str = "embedding") -> Whitening | None:
    """The whitening of an array column, from each distinct vector of whole numbers once; None without any vector.

    Arrays with null or non-finite entries don't count, and shorter ones are filled up with zeros. At most as many components as asked for, and none without variance.
    """
    common.prepare(rows.sparkSession)
    d = rows.where(whole(F.col(column)).isNotNull()).agg(F.max(F.size(column))).first()[0]
    if not d:
        return None
    if d > MOST_DIMENSIONS:
        raise ValueError(f"a vector has {d} entries, more than {MOST_DIMENSIONS}")
    distinct = common.stored(rows.select(whole(F.col(column), d).alias("x")).where("x is not null").distinct(), "distinct-vectors")
    n = distinct.count()
    sums = [int(s) for s in _summed(distinct, lambda x: x.astype(object).sum(0)[:, None], d, "decimal(38,0)", 1)[:, 0]]

    def centred(x):
        return (_scaled(x, n, sums) / n).astype(float)

    def products(x):
        y = centred(x)
        return y.T @ y

    covariance = _summed(distinct, products, d, "double", d) / n
    covariance, trace = (covariance + covariance.T) / 2, float(np.trace(covariance))
    e, v = spectrum(covariance, components)
    real = e > LEAST_SHARE * trace
    e, v = e[real], v[:, real]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(len(e))]) if len(e) else v
    projection = v / np.sqrt(e)

    def moments(x):
        w = np.column_stack([centred(x) @ projection, np.ones(len(x))])
        return w.T @ w

    error = 0.0
    if len(e):
        m = _summed(distinct, moments, d, "double", len(e) + 1) / n
        error = float(np.abs(m[:-1, :-1] - np.outer(m[-1, :-1], m[-1, :-1]) - np.eye(len(e))).max())
    common.discard(distinct)
    return Whitening(n, sums, e, v, trace, error)


def whitened(rows: DataFrame, by: Whitening, column: str = "embedding") -> DataFrame:
    """Adds whitened (array of doubles, one a component) and deviation to the rows whose vector is whole; the others are dropped.

    deviation is the sum of (n x - S)^2, null where that passes the longs. Columns of these names are replaced; a vector longer than those fitted is an error.
    """
    common.prepare(rows.sparkSession)
    d, projection, n, sums = len(by.sums), by.components / np.sqrt(by.values), by.n, by.sums
    kept = [c for c in rows.columns if c not in ("whitened", "deviation")]
    x = F.when(F.size(column) > d, F.raise_error(F.lit(f"a vector has more than {d} entries")).cast("array<long>")).otherwise(whole(F.col(column), d))
    ready = rows.select(*kept, x.alias("whitened")).where("whitened is not null")

    def squares(z: np.ndarray) -> list[int | None]:
        about = (z.astype(float) ** 2).sum(1)
        near = np.abs(about / 2.0**63 - 1) < 1e-6
        out: list[int | None] = [None] * len(z)
        small = np.nonzero((about < 2.0**63) & ~near)[0]  # no part of the sum overflows
        for k, s in zip(small.tolist(), (z[small].astype(np.int64) ** 2).sum(1).tolist()):
            out[k] = s
        for k in np.nonzero(near)[0].tolist():
            s = sum(int(v) ** 2 for v in z[k])
            out[k] = s if s < 1 << 63 else None
        return out

    def run(batches):
        import pyarrow as pa

        for batch in common.short(batches, 8192):
            z = _scaled(_vectors(batch.column(len(kept)), d), n, sums)
            w = (z / n).astype(float) @ projection
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.array(w.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(squares(z), pa.int64())], [*kept, "whitened", "deviation"])

    fields = [f for f in ready.schema.fields if f.name != "whitened"]
    return ready.mapInArrow(run, T.StructType([*fields, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())]))


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every vector: vec_id, component, n, deviation, whitened, explained, identity_error.

    Fewer components where fewer have variance; no rows without vectors. Rows that repeat, or have a null id, are rows of their own.
    """
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    by = fit(rows, 4)
    if by is None:
        return spark.createDataFrame([], RESULT)
    share = F.array(*map(F.lit, (by.values / by.trace).tolist())) if len(by.values) else F.array().cast("array<double>")
    long = whitened(rows, by).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return long.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("k") + 1).alias("explained"), F.lit(by.identity_error).alias("identity_error"))
