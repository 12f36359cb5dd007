"""Embedding whitening by spectral divide and conquer on polar decompositions (QDWH).

Entries become whole numbers ``x = floor(256 c)``, so distinct vectors, counts, sums and products are
exact and do not depend on the order of rows or on tasks run again:

1. Vectors are packed, one binary value each, and distinct ones are the fit list, ``n`` of them.
   Copies are merged before the shuffle, so a vector that a third of all rows hold is one row a task.
2. A pass over the fit list gives the sums ``S``; a second one the products of ``x - m``, with the
   whole numbers ``m`` nearest to ``S / n``. Both are reduced in each task and summed by Spark. What
   the rounded centre leaves is taken out exactly, so ``V`` is the covariance rounded once.
3. The covariance, dimensions squared in size, is split on the driver: with a shift inside its
   spectrum, the polar factor U of the shifted matrix is +1 above and -1 below, so (U + I) / 2
   projects on the subspace of the larger eigenvalues and (I - U) / 2 on the rest. An orthonormal
   basis of each gives two smaller problems, until one dimension is left. Halves that hold none of
   the wanted components are not split further.
4. Components and mean, dimensions x components in size, go to all tasks. A pass over the fit list
   measures the covariance of the whitened vectors, a pass over all rows whitens them.

Rows whose vector is null or holds null, NaN or infinite entries get no result; nor do vectors whose
length differs from that of most rows (ties: the longer), an empty vector for one. Entries beyond the
long range are held at its ends. Components whose eigenvalue vanishes against the largest (zero to
double precision) cannot be whitened and are left out, so few or constant vectors give fewer rows or
none. ``deviation`` is null where it exceeds a long. Rows that repeat an id, and rows without id, get
their results each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.shared import small_batches, written

SCALE = 256
EPS = float(np.finfo(float).eps)
LONG = 2**63 - 1


def pack_vector(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width that holds them all; equal vectors give equal bytes."""
    for width in (1, 2, 4, 8):
        kind = np.dtype(f"<i{width}")
        limit = np.iinfo(kind)
        if not len(x) or (x.min() >= limit.min and x.max() <= limit.max):
            return bytes([width]) + x.astype(kind).tobytes()
    raise OverflowError("not a long")


def unpack_vectors(column: pa.Array, dims: int) -> np.ndarray:
    """The (rows, dims) longs of a packed column."""
    out = np.empty((len(column), dims), np.int64)
    for i, value in enumerate(column):
        content = value.as_buffer()
        out[i] = np.frombuffer(content, f"<i{(content.size - 1) // dims}", dims, 1)
    return out


def scaled(entries: np.ndarray) -> np.ndarray:
    """floor(256 c) as long, held at the ends of the long range."""
    x = np.floor(entries.astype(np.float64) * SCALE)
    inside = np.abs(x) < 2.0**63
    ends = np.where(x > 0, LONG, -LONG - 1)
    return np.where(inside, np.where(inside, x, 0).astype(np.int64), ends)


def packed_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dims, x) of the rows with finite vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            entries = vectors.flatten()
            size = np.where(
                vectors.is_valid().to_numpy(zero_copy_only=False),
                vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False),
                0,
            ).astype(np.int64)
            end = np.cumsum(size)
            values = entries.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            good = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[end - size])
            keep = np.flatnonzero(good)
            packed = [pack_vector(scaled(values[end[i] - size[i] : end[i]])) for i in keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), pa.array(size[keep]), pa.array(packed, pa.binary())],
                names=["vec_id", "dims", "x"],
            )

    some = rows.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS vec_id", f"`{vector_col}` AS vector")
    some = some.withColumn("vector", F.col("vector").cast("array<double>"))
    return some.mapInArrow(pack, "vec_id bigint, dims bigint, x binary")


def add_up(total: np.ndarray | None, more: np.ndarray, most: int) -> np.ndarray:
    """``total + more``; Python's whole numbers where longs might not hold the sum."""
    if total is None:
        return more
    if most < LONG:
        return total + more
    return total.astype(object) + more.astype(object)


# Exact sums travel as two decimals, so that no sum of longs or of their products overflows.
_LIMB = 10**30
_CELL = "cell bigint, high string, low string"
_TOTALS = (
    "sum(CAST(high AS DECIMAL(38, 0))) AS high",
    "sum(CAST(low AS DECIMAL(38, 0))) AS low",
)


def _cells(cells: np.ndarray, totals: list[int]) -> pa.RecordBatch:
    limbs = [divmod(int(v), _LIMB) for v in totals]
    high, low = ([str(limb[i]) for limb in limbs] for i in (0, 1))
    return pa.RecordBatch.from_arrays(
        [pa.array(cells, pa.int64()), pa.array(high), pa.array(low)], names=["cell", "high", "low"]
    )


def _exact_totals(parts: DataFrame) -> Iterator[tuple[int, int]]:
    for row in parts.groupBy("cell").agg(*map(F.expr, _TOTALS)).toLocalIterator():
        yield row["cell"], int(row["high"]) * _LIMB + int(row["low"])


def column_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = unpack_vectors(batch.column(0), dims)
            wide = len(x) * max(abs(int(x.min(initial=0))), int(x.max(initial=0))) >= LONG
            part = (x.astype(object) if wide else x).sum(axis=0)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, part)]
        if n:
            yield _cells(np.arange(-1, dims), [n, *total])

    found = dict(_exact_totals(fit.select("x").mapInArrow(sums, _CELL)))
    return found.get(-1, 0), [found.get(i, 0) for i in range(dims)]


def centred_products(fit: DataFrame, centre: list[int]) -> np.ndarray:
    """Exact sums of (x - centre)(x - centre)', as an upper triangle of whole numbers."""
    dims = len(centre)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        bound = 0
        for batch in batches:
            if not len(batch.column(0)):
                continue
            x = unpack_vectors(batch.column(0), dims)
            most = max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, centre))
            wide = most * most * len(x) >= LONG
            x = x.astype(object) - np.array(centre, object) if wide else x - np.array(centre)
            # Doubles hold whole numbers below 2**53, and multiply matrices far faster than longs.
            exact = not wide and most * most * len(x) < 1 << 53
            x = x.astype(float) if exact else x
            part = x.T.dot(x)
            bound += most * most * len(x)
            total = add_up(total, part.astype(np.int64) if exact else part, bound)
        if total is not None:
            i, j = np.triu_indices(dims)
            for some in np.array_split(np.arange(len(i)), len(i) // 100_000 + 1):
                yield _cells(i[some] * dims + j[some], total[i[some], j[some]])

    out = np.zeros((dims, dims), object)
    for cell, total in _exact_totals(fit.select("x").mapInArrow(products, _CELL)):
        out[divmod(cell, dims)] = total
    return out


def covariance(n: int, sums: list[int], centre: list[int], products: np.ndarray) -> np.ndarray:
    """products / n less the product of what the centre leaves of the mean, rounded once."""
    rest = [s - n * c for s, c in zip(sums, centre)]
    out = np.empty(products.shape)
    for i in range(len(rest)):
        for j in range(i, len(rest)):
            out[i, j] = out[j, i] = (n * products[i, j] - rest[i] * rest[j]) / (n * n)
    return out


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps.

    Steps start from a lower bound of the smallest singular value. They factorise [sqrt(c) X; I] by
    QR while the weight c is large, and X'X + I / c by Cholesky, which is cheaper, when it is not.
    """
    size = len(a)
    eye = np.eye(size)
    x = a / max(min(np.linalg.norm(a), np.linalg.norm(a, 1)), np.finfo(float).tiny)
    try:
        low = max(1 / float(np.linalg.norm(np.linalg.inv(x))), EPS)
    except np.linalg.LinAlgError:
        low = EPS
    for _ in range(30):
        square = low * low
        d = (4 * max(1 - square, 0) / square**2) ** (1 / 3)
        root = np.sqrt(1 + d)
        weight = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        before = x
        if c > 100:
            q, _ = np.linalg.qr(np.vstack((np.sqrt(c) * x, eye)))
            x = b / c * x + (weight - b / c) / np.sqrt(c) * (q[:size] @ q[size:].T)
        else:
            factor = np.linalg.cholesky(eye + c * (x.T @ x))
            inverse = np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
            x = b / c * x + (weight - b / c) * inverse
        x = (x + x.T) / 2
        low = min(low * (weight + b * square) / (1 + c * square), 1.0)
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - before) <= np.cbrt(4 * EPS) * size:
            # One Newton-Schulz step takes the last rounding errors out.
            return 0.5 * (3 * x - x @ x @ x)
    return x


def invariant_halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces of the larger and the smaller eigenvalues of ``a``.

    None where ``a`` is a multiple of the identity to double precision.
    """
    size = len(a)
    mean = np.trace(a) / size
    spread = np.linalg.norm(a - mean * np.eye(size))
    if spread <= 4 * EPS * size * max(np.linalg.norm(a), np.finfo(float).tiny):
        return None
    random = np.random.default_rng(size)
    diagonal = np.diag(a)
    # Eigenvalues lie on both sides of the mean; a shift close to one of them is moved.
    shifts = [np.median(diagonal), mean, *(mean + spread / size * random.uniform(-0.5, 0.5, 40))]
    best = None
    for shift in shifts:
        projector = (polar(a - shift * np.eye(size)) + np.eye(size)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < size:
            continue
        upper, _ = np.linalg.qr(projector @ random.standard_normal((size, rank)))
        upper, _ = np.linalg.qr(projector @ upper)
        whole, _ = np.linalg.qr(np.hstack((upper, random.standard_normal((size, size - rank)))))
        lower = whole[:, rank:]
        coupling = np.linalg.norm(lower.T @ a @ upper)
        if best is None or coupling < best[0]:
            best = coupling, upper, lower
        if coupling <= 8 * EPS * size * np.linalg.norm(a):
            break
    if best is None:
        return None
    return best[1], best[2]


def components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    done: list[np.ndarray] = []
    open_blocks = [np.eye(len(a))]  # bases of invariant subspaces, the largest eigenvalues last
    while open_blocks and len(done) < wanted:
        basis = open_blocks.pop()
        if basis.shape[1] == 1:
            done.append(basis[:, 0])
            continue
        inner = basis.T @ a @ basis
        halves = invariant_halves((inner + inner.T) / 2)
        if halves is None:
            done += list(basis.T)
            continue
        for half in halves[::-1]:
            open_blocks.append(basis @ half)
    vectors = np.array(done[:wanted]).T.reshape(len(a), -1)
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def projected(x: np.ndarray, n: int, sums: list[int], axes: np.ndarray) -> np.ndarray:
    """(x - S / n) on the axes; n x - S is exact, so what cancels loses nothing."""
    return (deviations(x, n, sums).astype(float) / n) @ axes


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    if most < LONG:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(deviation: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row; None beyond a long."""
    most = max(abs(int(deviation.max(initial=0))), abs(int(deviation.min(initial=0))))
    if most * most * deviation.shape[1] > LONG:
        deviation = deviation.astype(object)
    total = ((int(v)) for v in (deviation * deviation).sum(axis=1))
    return [v if v <= LONG else None for v in total]


def identity_error(fit: DataFrame, dims: int, n: int, sums: list[int], axes: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = axes.shape[1]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = projected(unpack_vectors(batch.column(0), dims), n, sums, axes)
            total += np.vstack((w.sum(axis=0), w.T @ w))
        cells = np.arange(total.size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells), pa.array(total.ravel())], names=["cell", "total"]
        )

    parts = fit.select("x").mapInArrow(moments, "cell bigint, total double")
    found = parts.groupBy("cell").agg(F.sum("total").alias("total"))
    total = np.zeros((k + 1) * k)
    for row in found.collect():
        total[row["cell"]] = row["total"]
    mean, products = total[:k] / n, total[k:].reshape(k, k) / n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def whiten(
    rows: DataFrame, most: int = 4, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component.

    ``most`` bounds the components, numbered from 1 by falling eigenvalue.
    """
    small_batches(rows.sparkSession)
    vectors = written(packed_vectors(rows, id_col, vector_col), "whiten-vectors")
    sizes = vectors.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = int(sizes["dims"]) if sizes else 0
    vectors = vectors.filter(f"dims = {dims}")
    fit = written(vectors.select("x").distinct(), "whiten-fit")
    n, sums = column_sums(fit, dims) if dims else (0, [])
    values, axes = np.zeros(0), np.zeros((dims, 0))
    trace = 1.0
    if n:
        centre = [(2 * s + n) // (2 * n) for s in sums]
        v = covariance(n, sums, centre, centred_products(fit, centre))
        trace = float(np.trace(v))
        values, axes = components(v, min(most, dims)) if trace > 0 else (values, axes)
        real = values > dims * EPS * values.max(initial=0)
        values, axes = values[real], axes[:, real]
    axes = axes / np.sqrt(values)
    k = len(values)
    error = identity_error(fit, dims, n, sums, axes) if k else 0.0
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpack_vectors(batch.column(1), dims)
            size = len(x)
            spread = deviations(x, n, sums)
            white = (spread.astype(float) / n) @ axes
            squares = [v for v in square_sums(spread) for _ in range(k)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(size), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, n)),
                    pa.array(squares, pa.int64()),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = (
        "vec_id bigint, component int, n bigint, deviation bigint, whitened double,"
        " explained double, identity_error double"
    )
    chosen = vectors.select("vec_id", "x") if k else vectors.select("vec_id", "x").limit(0)
    return chosen.mapInArrow(project, schema)
