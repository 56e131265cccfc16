"""Whitening of embeddings: principal components of the distributed covariance by mixed-precision refinement.

Entries become whole numbers, so sums and deviations are exact.  The vectors of the fit list (each distinct
vector once) are centred on the exact mean and multiplied up inside the tasks; what the driver gets is one
covariance matrix, whatever the number of rows.  Its eigenvectors are found in float32 and corrected by
Ogita-Aishima iterations: a few matrix products a step, error squared at each, in extended precision.
Eigenvalues closer than the correction can tell apart are clusters; each is solved again by itself in the span
that its vectors have, where the shifted matrix shows the small differences.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescan.llm.common import dropped, shared_folder, stored

#: Entries are floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size and beyond are too large for exact whole numbers and count as not finite.
_LIMIT = 2.0 ** 52 / SCALE
#: Corrections of the float32 eigenvectors; each squares the error, so fewer do unless clusters are split late.
STEPS = 12
_WIDE = np.longdouble
_ROUNDING = 2.0 ** -50


def refine(matrix: np.ndarray, vectors: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix by falling eigenvalue, from approximate vectors.

    With X the vectors, R = I - X'X and S = X'AX, a step is X + XE, where E is R / 2 on the diagonal and inside clusters
    and (S_ij + l_j R_ij) / (l_j - l_i) elsewhere; clusters are turned to vectors of their own.  Products are in extended
    precision, results in double.
    """
    a, x = matrix.astype(_WIDE), vectors.astype(_WIDE)
    size = len(a)
    norm = np.abs(a).sum(axis=1).max(initial=0)
    if not size or not norm:
        return np.zeros(size), np.eye(size)
    # Eigenvalues closer than the matrix's own rounding have no vectors of their own; any basis of their span will do.
    floor = _ROUNDING * norm
    for _ in range(steps):
        r = np.eye(size, dtype=_WIDE) - x.T @ x
        s = x.T @ (a @ x)
        value = np.diag(s) / (1 - np.diag(r))
        delta = max(2 * (np.linalg.norm((s - np.diag(value)).astype(float)) + norm * np.linalg.norm(r.astype(float))), floor)
        order = np.argsort(-value)
        x, value, r, s = x[:, order], value[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        gap = value[None, :] - value[:, None]
        far = np.abs(gap) > delta
        correction = np.where(far, (s + value[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ correction
        clusters = _clusters(value, delta)
        for first, last in clusters:
            x[:, first:last] = _inside(a, x[:, first:last], value[first:last].mean())
        if np.abs(correction).max() < _ROUNDING and all(value[i] - value[j - 1] <= (j - i) * floor for i, j in clusters):
            break
    for _ in range(2):  # orthonormal to the last place
        x = x + x @ (np.eye(size, dtype=_WIDE) - x.T @ x) / 2
    value = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    return value[order].astype(float), x[:, order].astype(float)


def _clusters(value: np.ndarray, delta) -> list[tuple[int, int]]:
    """Runs of two or more neighbouring eigenvalues that are at most ``delta`` apart, as (first, end)."""
    edge = [0, *(np.flatnonzero(value[:-1] - value[1:] > delta) + 1), len(value)]
    return [(int(i), int(j)) for i, j in zip(edge, edge[1:]) if j - i > 1]


def _inside(a: np.ndarray, part: np.ndarray, shift) -> np.ndarray:
    """The span of a cluster's vectors turned to its own eigenvectors; shifted, so that differences of eigenvalues count."""
    inner = part.T @ (a @ part) - shift * (part.T @ part)
    scale = np.abs(inner).max()
    if not scale:
        return part
    # Scaled to one, the cluster's matrix in double shows gaps that the whole matrix hides.
    _, turn = np.linalg.eigh(((inner + inner.T) / (2 * scale)).astype(float))
    return part @ turn[:, ::-1].astype(_WIDE)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a symmetric matrix: float32 first, then refined.  Dimension numbers only, no rows."""
    norm = np.abs(matrix).max(initial=0) or 1.0
    _, rough = np.linalg.eigh((matrix / norm).astype(np.float32))
    return refine(matrix, rough)


def _vectors(column) -> np.ndarray:
    """A list column of equal lengths as a matrix of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S rounded once to double and divided by n, the exact sum of squares of n * x - S, as objects if wide)."""
    total = np.array(sums, dtype=object)
    if 2 * n * (int(np.abs(x).max(initial=0)) + 1) < 2 ** 63:
        whole = x * n - total.astype(np.int64)
        if int(np.abs(whole).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2 ** 63:
            return whole / n, (whole * whole).sum(axis=1)
    whole = x.astype(object) * n - total
    return (whole / n).astype(float), (whole * whole).sum(axis=1)


def _sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(rows, sum of each entry), exact; a row for each entry and task is shuffled."""
    def run(batches):
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = _vectors(batch.column(0))
            # Whole numbers are below 2**53, so sums of a thousand fit; those of a task may not.
            n, total = n + len(x), total + sum(
                part.sum(axis=0).astype(object) for part in np.array_split(x, len(x) // 1000 + 1))
        if n:
            yield pa.record_batch([pa.array(range(-1, dim), pa.int32()), pa.array([str(n), *map(str, total)])], names=["at", "total"])

    parts = rows.select("x").mapInArrow(run, "at INT, total STRING")
    found = {r.at: int(r.total) for r in parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def _products(rows: DataFrame, n: int, sums: list[int], turn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, mean product matrix) of the centred rows, or of their images under ``turn``.

    A task adds up one matrix; matrices are summed over tasks by entry, so the driver gets dim * dim numbers.
    """
    size = len(sums) if turn is None else turn.shape[1]
    upper = np.triu_indices(size)

    def run(batches):
        mean, square, any_row = np.zeros(size), np.zeros((size, size)), False
        for batch in batches:
            d = _centred(_vectors(batch.column(0)), n, sums)[0]
            d = d if turn is None else d @ turn
            mean, square, any_row = mean + d.sum(axis=0), square + d.T @ d, any_row or len(d) > 0
        if any_row:
            yield pa.record_batch([pa.array(np.concatenate([np.full(size, -1), upper[0]]), pa.int32()),
                                   pa.array(np.concatenate([np.arange(size), upper[1]]), pa.int32()),
                                   pa.array(np.concatenate([mean, square[upper]]))], names=["i", "j", "v"])

    parts = rows.select("x").mapInArrow(run, "i INT, j INT, v DOUBLE")
    mean, square = np.zeros(size), np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r.i < 0:
            mean[r.j] = r.v / n
        else:
            square[r.i, r.j] = square[r.j, r.i] = r.v / n
    return mean, square


def whole_vectors(rows: DataFrame, vector: str = "embedding", keep=("vec_id",)) -> DataFrame:
    """``_keep`` (struct of the columns in ``keep``) and ``x``: vectors without NULL, NaN, infinite or huge entries
    as whole numbers."""
    small = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < _LIMIT)
    # The guard stands inside as well, since Spark may work out x before it filters.
    whole = lambda c: F.when(small(c), F.floor(c.cast("double") * float(SCALE)).cast("long") + F.lit(SHIFT).cast("long"))
    return rows.where(F.col(vector).isNotNull() & F.forall(vector, small)).select(
        F.struct(F.lit(0).alias("_"), *keep).alias("_keep"), F.transform(vector, whole).alias("x"))


def fit(vectors: DataFrame, components: int = 16) -> dict:
    """The model from ``vectors(x)``: n, sums, components as columns, their eigenvalues, trace and identity error.

    Every distinct vector counts once.  The fit list is written to the shared folder and read three times: for the sums,
    for the covariance, and for the covariance of the whitened vectors, whose distance to the identity is the identity error.
    Vectors must have one length, which ``whiten`` sees to.
    """
    spark, folder = vectors.sparkSession, f"{shared_folder(vectors.sparkSession)}/whitening-{uuid.uuid4()}"
    unique = stored(vectors.select("x").distinct(), folder)
    first = unique.select(F.size("x").alias("dim")).limit(1).collect()
    dim = first[0].dim if first else 0
    if not dim:
        dropped(spark, folder)
        return {"n": len(first), "sums": [], "turn": np.zeros((0, 0)), "values": np.zeros(0), "trace": 0.0, "error": 0.0}
    n, sums = _sums(unique, dim)
    covariance = _products(unique, n, sums)[1]
    values, vectors_ = eigen(covariance)
    count, trace = min(components, dim), float(np.trace(covariance))
    values, turn = values[:count], vectors_[:, :count].copy()
    # Beyond the rank there is no variance to scale, only rounding.
    live = int((values > max(dim, 1) * 1e-14 * max(trace, 0)).sum())
    error = 0.0
    if live:
        scaled = turn[:, :live] / np.sqrt(values[:live])
        mean, square = _products(unique, n, sums, scaled)
        error = float(np.abs(square - np.outer(mean, mean) - np.eye(live)).max())
    dropped(spark, folder)
    return {"n": n, "sums": sums, "turn": turn, "values": np.where(np.arange(count) < live, values, 0.0),
            "trace": trace, "error": error}


def whiten(rows: DataFrame, vector: str = "embedding", keep=("vec_id",), components: int = 16) -> DataFrame:
    """``keep, component, n, deviation, whitened, explained, identity_error``: a row for each row and component.

    Rows whose vector is NULL or holds a NULL, NaN, infinite or huge (2**46 and more) entry are left out.  The most
    frequent length (of ties the longest) is the space; vectors of other lengths, and empty ones, are no points of it and are
    left out too.  deviation is exact; where it needs more than 64 bits it is NULL.  Components beyond the rank (all of them
    for a single distinct vector) have whitened NULL and explained 0, or NULL where nothing varies at all.  Repeated rows stay
    repeated and count once for the fit.  An empty table gives no rows.  Other columns are not read.
    """
    vectors = whole_vectors(rows, vector, keep)
    lengths = vectors.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    vectors = vectors.where(F.size("x") == (lengths[0].dim if lengths else 0)).where("size(x) > 0")
    model = fit(vectors, components)
    values, n, sums, turn = model["values"], model["n"], model["sums"], model["turn"]
    count, live = len(values), int((values > 0).sum())
    scaled = turn[:, :live] / np.sqrt(values[:live])
    explained = values / model["trace"] if model["trace"] > 0 else None

    def run(batches):
        for batch in batches:
            x = _vectors(batch.column(1))
            if not len(x) or not count:
                continue
            d, squares = _centred(x, n, sums)
            image = np.full((len(x), count), np.nan)
            image[:, :live] = d @ scaled
            rows_of = np.repeat(np.arange(len(x)), count)
            white = image.ravel()
            yield pa.record_batch([
                batch.column(0).take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                pa.array(np.full(len(rows_of), n), pa.int64()),
                pa.array([v if -2 ** 63 <= v < 2 ** 63 else None for v in squares.tolist()], pa.int64()).take(pa.array(rows_of)),
                pa.array(white, mask=np.isnan(white)),
                pa.array(np.tile(explained, len(x))) if explained is not None else pa.nulls(len(rows_of), pa.float64()),
                pa.array(np.full(len(rows_of), model["error"]))], schema=batch_schema(batch))

    def batch_schema(batch):
        return pa.schema([batch.schema.field(0), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                          ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    out = T.StructType([vectors.schema["_keep"]])
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"),
                       ("explained", "double"), ("identity_error", "double")):
        out = out.add(name, kind)
    done = vectors.select("_keep", "x").mapInArrow(run, out)
    return done.select(*[F.col("_keep")[c].alias(c) for c in keep], "component", "n", "deviation", "whitened", "explained",
                       "identity_error")
