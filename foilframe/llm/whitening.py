"""Whitening of embeddings by Jacobi-Davidson over distributed products (operator 13).

The covariance is never formed. A product of it with a few vectors is one pass
over the fit list, whose entries are centred before they are multiplied; a task
returns as many numbers as the vectors have, and Spark adds them up. What the
driver holds are vectors as long as an embedding: a search space of at most
SPACE of them with their products, and the eigenvectors that are locked.

A round takes Ritz pairs from the search space and locks those whose residual is
down to double precision, largest first. For the others it solves the correction
equations, projected against locked and current vectors, by MINRES: the
recurrences of all pairs go in step, so that a step of all of them is one
product. The corrections widen the search space, which is cut back to the best
Ritz vectors when it is full.

Rules: entries become x = floor(64 * c) + 1000000. Rows whose vector is null, or
holds a null, non-finite or too large entry (x is no long then), are left out,
and so are those of another length than most rows have (of equally frequent
lengths the larger). Repeated vectors count once in the fit and are all whitened.
Components whose variance is no more than NO_VARIANCE of the largest have none
in double precision and are left out; without variance, or without rows, the
result is empty. A deviation that is no long is null. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foilframe.llm.staging import stage
from foilframe.llm.textblocks import lean

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 16
#: Vectors beside the wanted ones, so that close eigenvalues at the end of the list are told apart.
GUARD = 4
#: Vectors of the search space at most, but no fewer than three times those wanted.
SPACE = 64
INNER, INNER_TOLERANCE = 8, 0.02
#: Residuals, as a part of the largest eigenvalue, that count as double precision.
PRECISION = 32 * np.finfo(np.float64).eps
#: Without progress for a few rounds a residual must be below this.
STALLED = 1e-12
ROUNDS = 200
NO_VARIANCE = 1e-10
BLOCK_BYTES = 2 << 20
#: Sums of tasks that the driver adds up itself.
DIRECT = 64


def steps_of(vector: Column) -> Column:
    """A vector as whole numbers."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """The id as _id and x for each row that remains, and the length of x; 0 where no row remains."""
    vector, fits = F.col(vector_col), lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < float(1 << 62))  # noqa: E731  # NaN is above any number
    rows = embeddings.select(F.col(id_col).alias("_id"), vector.alias("_vector")).filter(F.col("_vector").isNotNull() & (F.size("_vector") > 0) & F.forall("_vector", fits))
    lengths = rows.groupBy(F.size("_vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return rows.filter(F.size("_vector") == d).select("_id", steps_of(F.col("_vector")).alias("x")), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class FitList:
    """The distinct vectors in blocks of a written table, with their exact sums."""

    def __init__(self, rows: DataFrame, d: int):
        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            each = max(1, BLOCK_BYTES // (8 * d))
            for batch in batches:
                x = _matrix(batch.column(0), d)
                parts = [x[k : k + each] for k in range(0, len(x), each)]
                yield pa.RecordBatch.from_arrays([pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], names=["block"])

        self.d = d
        self.blocks = stage(rows.select("x").distinct().mapInArrow(lean(blocks), "block binary"), "whitening-fit")
        self.n_blocks = self.blocks.count()
        self.n, self.sums = self._exact_sums()
        self.whole, self.part = (np.array(c) for c in zip(*[divmod(s, self.n) for s in self.sums]))  # the mean is whole + part / n
        self.part_of_n = np.array([int(p) / self.n for p in self.part])

    def _exact_sums(self) -> tuple[int, list[int]]:
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            high, low, n = np.zeros(d + 1, np.int64), np.zeros(d + 1, np.int64), 0
            for batch in batches:
                for block in batch.column(0):
                    x = np.frombuffer(block.as_py(), "<i8").reshape(-1, d)
                    high[:d] += (x >> 32).sum(axis=0)
                    low[:d] += (x & 0xFFFFFFFF).sum(axis=0)
                    n += len(x)
            low[d] = n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1), pa.int32()), pa.array(high), pa.array(low)], names=["k", "high", "low"])

        found = self.blocks.mapInArrow(lean(run), "k int, high long, low long").groupBy("k").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")])
        sums = {r["k"]: (int(r["high"]) << 32) + int(r["low"]) for r in found.collect()}  # d + 1 rows
        return sums[d], [sums[k] for k in range(d)]

    def added(self, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over all blocks of what part gives for the centred rows of each, an array of size numbers.

        Of more than DIRECT tasks the sums are added up in the root of as many
        tasks first, so that the driver gets few of them at any size.
        """
        d, whole, rest = self.d, self.whole, self.part_of_n

        def sums(batches: Iterator[pa.RecordBatch], of: Callable[[pa.Scalar], np.ndarray]) -> Iterator[pa.RecordBatch]:
            total, any_ = np.zeros(size), False
            for batch in batches:
                for x in batch.column(0):
                    total += of(x)
                    any_ = True
            if any_:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return sums(batches, lambda x: part((np.frombuffer(x.as_buffer(), "<i8").reshape(-1, d) - whole) - rest))

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return sums(batches, lambda x: np.frombuffer(x.as_buffer()))

        found = self.blocks.mapInArrow(first, "v binary")
        if self.n_blocks > DIRECT:  # no more tasks than blocks have any
            found = found.repartition(math.isqrt(self.n_blocks)).mapInArrow(again, "v binary")
        return sum((np.frombuffer(r["v"]) for r in found.collect()), np.zeros(size))

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance times some vectors, given as columns: one pass."""
        k = vectors.shape[1]
        return self.added(lambda c: (c.T @ (c @ vectors)).ravel(), self.d * k).reshape(self.d, k) / self.n

    def trace(self) -> float:
        return float(self.added(lambda c: np.array([np.einsum("ij,ij->", c, c)]), 1)[0]) / self.n


def orthonormal(vectors: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what vectors add to the orthonormal columns of against; what adds nothing is left out."""
    out = np.zeros((len(vectors), 0))
    for v in vectors.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            for q in (*against, out):
                v = v - q @ (q.T @ v)
        left = np.linalg.norm(v)
        if size > 0 and left > 1e-8 * size:
            v = v / left
            for q in (*against, out):
                v = v - q @ (q.T @ v)
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int = INNER, tolerance: float = INNER_TOLERANCE) -> np.ndarray:
    """Solutions of symmetric systems by MINRES, one for each column; all recurrences go in step, so a step is one call of apply."""
    size = np.linalg.norm(right, axis=0)
    live = np.where(size > 0, size, 1)
    x, v_old, w_old, w = (np.zeros_like(right) for _ in range(4))
    v, beta, eta = right / live, np.zeros_like(size), size.copy()
    c_old, c, s_old, s = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        first, second, third = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        rho = np.hypot(first, beta_new)
        safe = np.where(rho > 0, rho, 1)
        c_old, s_old = c, s
        c, s = np.where(rho > 0, first / safe, 1), np.where(rho > 0, beta_new / safe, 0)
        w_old, w = w, np.where(rho > 0, (v - third * w_old - second * w) / safe, 0)
        x = x + c * eta * w
        eta = -s * eta
        v_old, v, beta = v, np.where(beta_new > 0, p / np.where(beta_new > 0, beta_new, 1), 0), beta_new
        if (np.abs(eta) <= tolerance * size).all():
            break
    return x


def largest_pairs(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = COMPONENTS, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric d x d operator, their unit vectors as columns, and their residuals.

    product: the operator times columns, the only way in which it is used.
    """
    wanted = min(wanted, d)
    most = max(SPACE, 3 * wanted)
    locked, values = np.zeros((d, 0)), []
    space = orthonormal(np.random.default_rng(seed).normal(size=(d, min(d, wanted + GUARD))))
    image = product(space)
    best, stalled = math.inf, 0
    for _ in range(ROUNDS):
        inner = space.T @ image
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        off = image - space * theta
        off -= locked @ (locked.T @ off)
        norms, scale, need = np.linalg.norm(off, axis=0), max([*values, theta[0]]), min(wanted - len(values), len(theta))
        worst = norms[:need].max()
        best, stalled = (worst, 0) if worst < best / 2 else (best, stalled + 1)
        allowed = max(PRECISION, STALLED if stalled > 3 else 0) * scale
        done = norms[:need] <= allowed
        lead = need if done.all() else int(np.argmin(done))
        if lead:
            locked = np.column_stack([locked, space[:, :lead]])
            values += theta[:lead].tolist()
            space, image, off, norms, theta, best, stalled = space[:, lead:], image[:, lead:], off[:, lead:], norms[lead:], theta[lead:], math.inf, 0
            need -= lead
        if len(values) == wanted:
            break
        open_ = np.flatnonzero(norms[:need] > allowed)
        if space.shape[1] + len(open_) > most:
            space, image = space[:, : need + GUARD], image[:, : need + GUARD]
        wall = np.column_stack([locked, space[:, :need]])  # the corrections are orthogonal to these

        def project(z: np.ndarray, wall=wall) -> np.ndarray:
            z = z - wall @ (wall.T @ z)
            return z - wall @ (wall.T @ z)

        at = theta[open_]
        more = minres(lambda z, project=project, at=at: project(product(z) - z * at), project(-off[:, open_]))
        more = orthonormal(more, locked, space)
        if not more.shape[1]:  # the corrections lie in the space already: look elsewhere
            more = orthonormal(np.random.default_rng(seed + len(values) + space.shape[1]).normal(size=(d, max(1, len(open_)))), locked, space)
        if more.shape[1]:
            space, image = np.column_stack([space, more]), np.column_stack([image, product(more)])
    else:
        raise ArithmeticError("the eigenvectors didn't come down to double precision")
    image = product(locked)  # afresh, and once more turned to each other
    inner = locked.T @ image
    theta, turn = np.linalg.eigh((inner + inner.T) / 2)
    theta, turn = theta[::-1], turn[:, ::-1]
    vectors = locked @ turn
    return theta, vectors, np.linalg.norm(image @ turn - vectors * theta, axis=0)


def components(fit: FitList, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances, unit vectors and residuals of the components that have a variance, largest first."""
    values, vectors, residuals = largest_pairs(fit.product, fit.d, wanted)
    has = values > NO_VARIANCE * max(values[0], 0)
    return values[has], vectors[:, has], residuals[has]


def whiten(embeddings: DataFrame, wanted: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error, variance and residual for each row that remains and component."""
    kind = embeddings.schema[id_col].dataType.simpleString()
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error", "variance", "residual"]
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, variance double, residual double"
    rows, d = usable(embeddings, id_col, vector_col)
    if not d:
        return embeddings.sparkSession.createDataFrame([], schema)
    fit = FitList(rows, d)
    values, vectors, residuals = components(fit, wanted)
    k, n = len(values), fit.n
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    explained = values / fit.trace()
    onto = vectors / np.sqrt(values)
    cells = fit.added(lambda c: np.concatenate([((z := c @ onto).T @ z).ravel(), z.sum(axis=0)]), k * k + k) / n
    error = float(np.abs(cells[: k * k].reshape(k, k) - np.outer(cells[k * k :], cells[k * k :]) - np.eye(k)).max())
    whole, part, rest = fit.whole, fit.part, fit.part_of_n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            made = (((x - whole) - rest) @ onto).ravel()
            times = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(times), k))), pa.array(np.tile(np.arange(1, k + 1), times), pa.int32()), pa.array(np.full(times * k, n)),
                    pa.array(deviations(x - whole, part, n), pa.int64()).take(pa.array(np.repeat(np.arange(times), k))), pa.array(made), pa.array(np.tile(explained, times)), pa.array(np.full(times * k, error)),
                    pa.array(np.tile(values, times)), pa.array(np.tile(residuals, times)),
                ],
                names=[id_col, *names],
            )

    return rows.mapInArrow(run, schema)


def deviations(apart: np.ndarray, part: np.ndarray, n: int) -> list[int | None] | np.ndarray:
    """Sums of (n * apart - part) ** 2 along rows, exactly; None where one is no long."""
    d = apart.shape[1]
    most = float(np.abs(apart.astype(np.float64)).max(initial=0)) * n + n
    if most * most * d < 2.0**62:
        far = n * apart.astype(np.int64) - part.astype(np.int64)
        return (far * far).sum(axis=1)
    sums = [sum((n * a - p) ** 2 for a, p in zip(row, part.tolist())) for row in apart.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
