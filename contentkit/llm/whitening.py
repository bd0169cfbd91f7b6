"""Embedding whitening by a block Jacobi-Davidson iteration with matrix-free distributed products.

Vectors are put on a grid of integers (64 steps to one, shifted by a million), so that the different ones can be told exactly.  The list of
different vectors is written to the shared folder once; its covariance is never formed.  Whatever the iteration needs of it is
a product with a few columns: every task centres its rows, multiplies them, and hands on the sum of its rows' contributions as one array,
and a few tasks add those; the driver sees their sums, as many numbers as dimensions times columns.

* Rayleigh-Ritz in a search space of orthonormal columns gives approximate components.
* Those whose residual has reached double precision are locked; the search goes on orthogonal to them.
* For all others at once the projected correction equation is solved by a few steps of MINRES (the projected, shifted covariance
  is symmetric and indefinite), one distributed product for a step; the corrections widen the search space, which is
  restarted from its best Ritz vectors when it has grown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from contentkit.llm.storage import stage

#: Steps of the grid to one, its shift, and the largest value on it.
STEPS, SHIFT, LIMIT = 64, 1_000_000, 1 << 60
#: Tasks that add the sums of all others.
REDUCERS = 16
_ADDED = ["n", "deviation", "whitened", "explained", "identity_error"]


@dataclass(frozen=True)
class Iteration:
    """*inner*: MINRES steps of one correction; *tolerance*: residual that is locked, as a share of the largest eigenvalue;
    *outer*: rounds after which the iteration gives up with an error."""

    inner: int = 8
    tolerance: float = 8e-15
    outer: int = 200


@dataclass(frozen=True)
class Whitening:
    """Fitted components: *vectors* has one column for each, by falling *values*; *n* different vectors with the exact *sums*."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float


def _centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows minus the mean, as doubles: the whole part of the mean goes off exactly, the rest is one rounded subtraction."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - part


def _orthonormal(columns: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what *columns* add to the span of *others* (each orthonormal, and to each other)."""
    base = np.hstack([o for o in others if o.size] or [np.zeros((len(columns), 0))])
    out = []
    for v in columns.T:
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v = v / size
        for _ in range(3):  # projecting again removes what rounding left
            before = np.linalg.norm(v)
            v = v - base @ (base.T @ v)
            for u in out:
                v = v - u * (u @ v)
            if np.linalg.norm(v) > 0.5 * before:
                break
        size = np.linalg.norm(v)
        if size > 1e-8 and base.shape[1] + len(out) < len(columns):
            out.append(v / size)
    return np.array(out).T if out else np.zeros((len(columns), 0))


def minres(product: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, right: np.ndarray, project: Callable[[np.ndarray], np.ndarray],
           steps: int, reduction: float = 1e-3) -> np.ndarray:
    """Columns t with project((M - shift) t) = right, nearly: each column its own Lanczos run, all of them one product a step."""
    out, old_w, w, old_v = (np.zeros_like(right) for _ in range(4))
    start = beta = np.linalg.norm(right, axis=0)
    live = start > 0
    v = right / np.where(live, start, 1)
    beta, eta = np.zeros_like(start), start.copy()
    old_c, c, old_s, s = np.ones_like(start), np.ones_like(start), np.zeros_like(start), np.zeros_like(start)
    for _ in range(steps):
        if not live.any():
            break
        p = project(product(v) - v * shifts)
        alpha = (v * p).sum(0)
        p = p - v * alpha - old_v * beta
        nxt = np.linalg.norm(p, axis=0)
        diagonal = c * alpha - old_c * s * beta
        rho = np.hypot(diagonal, nxt)
        live &= rho > 0
        safe = np.where(live, rho, 1)
        new_w = (v - old_w * (old_s * beta) - w * (s * alpha + old_c * c * beta)) / safe
        old_c, c, old_s, s = c, np.where(live, diagonal / safe, 1), s, np.where(live, nxt / safe, 0)
        out = out + new_w * np.where(live, c * eta, 0)
        eta = -s * eta
        old_w, w, old_v = w, new_w, v
        live &= (np.abs(eta) > reduction * start) & (nxt > 0)
        v, beta = p / np.where(nxt > 0, nxt, 1), nxt
    return out


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], size: int, count: int, how: Iteration = Iteration()):
    """(values, vectors, residuals) of the *count* largest eigenpairs of a symmetric operator on *size* dimensions, given its product.

    The start is a fixed random space, so equal products give equal results.
    """
    count = min(count, size)
    space = _orthonormal(np.random.default_rng(1).standard_normal((size, min(size, 2 * count))))
    image = product(space)
    locked, values, residuals = np.zeros((size, 0)), np.zeros(0), np.zeros(0)
    best, still = np.inf, 0
    for _ in range(how.outer):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, image = space @ turn, image @ turn
        if len(values) >= count and (not len(theta) or theta[0] <= np.sort(values)[-count]):
            break
        want = min(max(count - len(values), 1), len(theta))
        top = max([theta[0], *values]) if len(theta) else max(values, default=0.0)
        away = image[:, :want] - ritz[:, :want] * theta[:want]
        away -= locked @ (locked.T @ away)
        sizes = np.linalg.norm(away, axis=0)
        # Rounding in the products sets a floor a little above or below the tolerance: no progress near it is the floor.
        still = still + 1 if sizes.max(initial=0.0) > 0.5 * best else 0
        best = min(best, sizes.max(initial=0.0))
        full = len(theta) + len(values) >= size
        done = (sizes <= how.tolerance * top) | full | ((still >= 4) & (sizes <= 1e3 * how.tolerance * top))
        if done.any():
            locked, values, residuals = np.hstack([locked, ritz[:, :want][:, done]]), np.append(values, theta[:want][done]), np.append(residuals, sizes[done])
            best, still = np.inf, 0
        stay = np.append(~done, np.ones(len(theta) - want, bool))
        space, image, theta = ritz[:, stay], image[:, stay], theta[stay]
        if not (~done).any():
            if not len(theta) and len(values) < count:
                break
            continue
        open_ritz, open_theta, open_away = space[:, :(~done).sum()], theta[:(~done).sum()], away[:, ~done]
        outside = np.hstack([locked, open_ritz])

        def project(t: np.ndarray, q: np.ndarray = outside) -> np.ndarray:
            return t - q @ (q.T @ t)

        if space.shape[1] > 6 * count:
            space, image = space[:, :3 * count], image[:, :3 * count]
        new = _orthonormal(minres(product, open_theta, project(-open_away), project, how.inner), locked, space)
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    else:
        raise RuntimeError(f"no convergence after {how.outer} rounds: {len(values)} of {count} components")
    order = np.argsort(-values, kind="stable")[:count]
    return values[order], locked[:, order], residuals[order]


def _usable(vector: Column) -> Column:
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(
        F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def _on_grid(lists: pa.ListArray) -> np.ndarray:
    """Rows of whole numbers of a batch whose vectors have one length."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.clip(np.floor(values * STEPS), -LIMIT, LIMIT).astype(np.int64).reshape(len(lists), -1) + SHIFT


def _rows(packed: pa.BinaryArray) -> np.ndarray:
    """Vectors that were written as bytes."""
    return np.frombuffer(b"".join(packed.to_pylist()), np.int64).reshape(len(packed), -1)


def _reduced(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray], add: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type) -> np.ndarray | None:
    """*part* of all batches of rows, joined by *add*: one array for a task, added again by a few tasks before the driver adds theirs."""
    def fold(arrays) -> Iterator[pa.RecordBatch]:
        total = None
        for now in arrays:
            total = now if total is None else add(total, now)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def of_rows(batches):
        return fold(part(_rows(b.column(0))) for b in batches if b.num_rows)

    def of_parts(batches):
        return fold(np.frombuffer(data, kind) for b in batches for data in b.column(0).to_pylist())

    found = blocks.mapInArrow(of_rows, "part binary").repartition(REDUCERS).mapInArrow(of_parts, "part binary").collect()
    total = None
    for row in found:
        now = np.frombuffer(row.part, kind)
        total = now if total is None else add(total, now)
    return total


def _summed(blocks: DataFrame, cells: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of *part* (an array of *cells* numbers for a batch of rows)."""
    total = _reduced(blocks, lambda x: np.ascontiguousarray(part(x), float).ravel(), np.add, float)
    return np.zeros(cells) if total is None else total


def _exact_sums(blocks: DataFrame) -> list[int]:
    """Exact sums of every dimension, as high and low halves that cannot overflow."""
    def halves(x: np.ndarray) -> np.ndarray:
        return carried((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))

    def carried(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.concatenate([high + (low >> 32), low & 0xFFFFFFFF])

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = len(a) // 2
        return carried(a[:size] + b[:size], a[size:] + b[size:])

    total = _reduced(blocks, halves, add, np.int64)
    size = 0 if total is None else len(total) // 2
    return [int(total[k]) * (1 << 32) + int(total[size + k]) for k in range(size)]


def distinct_vectors(vectors: DataFrame, vector_col: str, size: int) -> DataFrame:
    """(x) as bytes, each different grid vector of *size* entries once; copies are combined before the shuffle."""
    rows = vectors.filter(_usable(F.col(f"`{vector_col}`")) & (F.size(f"`{vector_col}`") == size)).select(F.col(f"`{vector_col}`").alias("v"))

    def pack(batches):
        for batch in batches:
            x = _on_grid(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    return rows.mapInArrow(pack, "x binary").distinct()


def vector_size(vectors: DataFrame, vector_col: str) -> int:
    """The length that most usable vectors have (the greater of two that are as frequent); 0 without any."""
    sizes = vectors.filter(_usable(F.col(f"`{vector_col}`"))).groupBy(F.size(f"`{vector_col}`").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    top = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
    return top["size"] if top else 0


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 16, how: Iteration = Iteration()) -> Whitening:
    """Mean and leading components of the different vectors of a table.

    Vectors that are null, empty, or hold a null, a NaN or an infinity are left out, and so are vectors of another length than most
    have.  Copies count once.  Components without variance (at most 1e-12 of the largest) are left out, so there may be fewer
    than asked for: none where all vectors are equal or the table is empty.  Signs make the largest entry of a component positive.
    """
    size = vector_size(vectors, vector_col)
    if not size:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, np.zeros(0), 0.0)
    blocks = stage(distinct_vectors(vectors, vector_col, size), "vectors")
    n, sums = blocks.count(), _exact_sums(blocks)

    def product(columns: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = _centre(x, n, sums)
            return y.T @ (y @ columns)

        return _summed(blocks, columns.size, part).reshape(columns.shape) / n

    trace = float(_summed(blocks, 1, lambda x: np.array([(_centre(x, n, sums) ** 2).sum()]))[0] / n)
    none = Whitening(n, sums, np.zeros(0), np.zeros((size, 0)), trace, np.zeros(0), 0.0)
    if trace == 0:
        return none
    values, found, _ = jacobi_davidson(product, size, components, how)
    found = found[:, values > 1e-12 * values[0]]
    image = product(found)
    values = (found * image).sum(0)
    residuals = np.linalg.norm(image - found * values, axis=0)
    found = found * np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])
    k = found.shape[1]

    def gram(x: np.ndarray) -> np.ndarray:
        y = _centre(x, n, sums) @ found / np.sqrt(values)
        return np.vstack([y.T @ y, y.sum(0)])

    moments = _summed(blocks, k * (k + 1), gram).reshape(k + 1, k) / n
    error = np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max()
    return Whitening(n, sums, values, found, trace, residuals, float(error))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over the dimensions of (n * x - S) ** 2; None beyond the range of a long."""
    away = x - np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    if len(x) and (n * (int(np.abs(away).max()) + 1)) ** 2 * x.shape[1] < 1 << 63:
        return ((away * n - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * a - r) ** 2 for a, r in zip(row, rest)) for row in away.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def transform(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> DataFrame:
    """The columns of *vectors* but the vector, with n, deviation, and whitened and explained (arrays, one entry for a component).

    Rows whose vector the fit leaves out are left out here too; repeated rows stay.  deviation is null beyond the range of a
    long.  Own columns with one of the added names are replaced.  Nothing is shuffled.
    """
    size = len(model.sums)
    carried = [c for c in vectors.columns if c not in _ADDED and c != vector_col]
    rows = vectors.filter(_usable(F.col(f"`{vector_col}`")) & (F.size(f"`{vector_col}`") == size)).select(
        *[F.col(f"`{c}`") for c in carried], F.col(f"`{vector_col}`"))
    schema = rows.drop(vector_col).schema.add("n", "long").add("deviation", "long").add("whitened", ArrayType(DoubleType())).add(
        "explained", ArrayType(DoubleType())).add("identity_error", "double")
    explained = (model.values / model.trace).tolist() if len(model.values) else []

    def whiten(batches):
        for batch in batches:
            x = _on_grid(batch.column(len(carried)))
            many = len(x)
            projected = _centre(x, model.n, model.sums) @ model.vectors / np.sqrt(model.values)
            offsets = pa.array(np.arange(many + 1) * projected.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:len(carried)], pa.array([model.n] * many, pa.int64()), pa.array(_deviations(x, model.n, model.sums), pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(projected.ravel())), pa.array([explained] * many, pa.list_(pa.float64())),
                pa.array([model.identity_error] * many, pa.float64())], schema.names)

    return rows.mapInArrow(whiten, schema)


def component_report(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable vector and component (from 1): id, component, n, deviation, whitened, explained, identity_error."""
    found = transform(vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")), model, "v")
    each = found.select("id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "value"))
    return each.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"),
                       F.get("explained", F.col("at")).alias("explained"), "identity_error")
