"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V are found without V: a pass over the stored
vectors gives the product of V with a block of columns, summed over tasks by Spark. A
Chebyshev polynomial of V, by its three-term recurrence of such passes, damps what belongs
to the unwanted part of the spectrum; QR and a Rayleigh-Ritz step follow, until the residual
of each wanted pair certifies it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import stored, table

COMPONENTS = 16
SCALE = 64  # vectors are put on a grid: floor(SCALE * entry)
LARGEST = float(1 << 55)  # beyond this size an entry has no place on the grid
DEGREE = 12  # of a filter, at most
SPREAD = 1e7  # by how much one filter may pull the wanted columns apart
SETTLED = 1e-14  # residual over the largest eigenvalue at which a pair is exact
CERTIFIED = 1e-10  # the least that is accepted where rounding ends the progress
RANK = 1e-12  # eigenvalues below this part of the largest count as zero
ROUNDS = 100
LANCZOS = 12  # steps that bound the spectrum from below


def gridded(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, g) of the rows that have a vector of finite entries; g = floor(scale * entry)."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)))
    usable = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(finite, F.lit(False))
    grid = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    return rows.where(usable).select(F.col(vec_id).alias("vec_id"), grid.alias("g"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows of 64-bit integers."""
    return np.asarray(pc.list_flatten(batch.column("g"))).reshape(batch.num_rows, -1)


def summed(fit: DataFrame, rows: int, columns: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of a matrix that is worked out from each batch of vectors.

    A task adds up its batches and passes on the cells of one matrix; cells are added by
    key, so the driver receives a single matrix whatever the number of tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch))
        yield pa.RecordBatch.from_pydict({"cell": np.arange(rows * columns, dtype=np.int64), "value": total.ravel()})

    cells = fit.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(rows * columns)
    out[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    return out.reshape(rows, columns)


def exact_sums(fit: DataFrame, width: int) -> list[int]:
    """The sum of each dimension, exact: halves of the entries are added as integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * width
        for batch in batches:
            if batch.num_rows:
                g = matrix(batch)
                high, low = (g >> 31).sum(axis=0), (g & 0x7FFFFFFF).sum(axis=0)
                totals = [t + (h << 31) + l for t, h, l in zip(totals, high.tolist(), low.tolist())]
        values = pa.array(totals, pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), values], names=["cell", "value"])

    cells = fit.mapInArrow(run, "cell long, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value"))
    found = {r["cell"]: int(r["value"]) for r in cells.collect()}
    return [found.get(i, 0) for i in range(width)]


# -- the iteration, on any symmetric operator without negative eigenvalues ------------------


class LowerBound:
    """Lanczos steps from a random vector; they bound the smallest eigenvalue from below."""

    def __init__(self, start: np.ndarray):
        self.basis, self.diagonal, self.beside = [start / np.linalg.norm(start)], [], []

    def wanted(self) -> np.ndarray | None:
        """The vector whose image the next step needs; None when done."""
        return self.basis[-1] if len(self.diagonal) < min(LANCZOS, len(self.basis[0])) and len(self.basis) > len(self.diagonal) else None

    def step(self, image: np.ndarray) -> None:
        self.diagonal.append(float(self.basis[-1] @ image))
        q = np.stack(self.basis, axis=1)
        for _ in range(2):
            image = image - q @ (q.T @ image)
        length = float(np.linalg.norm(image))
        self.beside.append(length)
        if length > 1e-12 * max(map(abs, self.diagonal)):
            self.basis.append(image / length)

    def value(self) -> float:
        if not self.diagonal:
            return 0.0
        t = np.diag(self.diagonal) + np.diag(self.beside[:-1], 1) + np.diag(self.beside[:-1], -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - self.beside[-1])


@dataclass
class Spectrum:
    values: np.ndarray
    vectors: np.ndarray  # one column each
    residuals: np.ndarray
    passes: int


def growth(x: float) -> float:
    """By how much a degree of the filter lifts what lies at x, in units of the damped interval."""
    return x + np.sqrt(x * x - 1) if x > 1 else 1.0


def leading(apply: Callable[[np.ndarray], np.ndarray], width: int, k: int, block: int | None = None, seed: int = 13) -> Spectrum:
    """The ``k`` largest eigenpairs with eigenvalues above zero, largest first.

    ``apply`` gives the product with a matrix of columns. The block has ``2 k`` columns;
    its smallest Ritz value is where the damped interval ends. Where the block is as wide
    as the space, one product gives all. Raises if the residuals cannot be certified.
    """
    block = min(width, block or 2 * k)
    k = min(k, width)
    rng = np.random.default_rng(seed)
    q = np.eye(width) if block == width else np.linalg.qr(rng.standard_normal((width, block)))[0]
    bound, passes, before = LowerBound(rng.standard_normal(width)), 0, np.inf

    def image(y: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        ask = bound.wanted() if block < width else None
        if ask is None:
            return apply(y)
        out = apply(np.column_stack([y, ask]))
        bound.step(out[:, -1])
        return out[:, :-1]

    for _ in range(ROUNDS):
        vq = image(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(float(values[0]), 0.0)
        full = int((values[:k] > RANK * top).sum()) if top > 0 else 0
        residuals = np.linalg.norm(vq[:, :full] - q[:, :full] * values[:full], axis=0)
        worst = float(residuals.max()) / top if full else 0.0
        if worst <= SETTLED or block == width or (worst <= CERTIFIED and worst > before / 4):
            return Spectrum(values[:full], q[:, :full], residuals, passes)
        before = worst
        low, cut = bound.value(), max(float(values[-1]), 1e-8 * top)
        low = min(low, 0.99 * cut)
        centre, half = (cut + low) / 2, (cut - low) / 2
        pull = growth((top - centre) / half) / growth((float(values[full - 1]) - centre) / half)
        degree = DEGREE if pull <= 1.001 else int(np.clip(np.log(SPREAD) / np.log(pull), 2, DEGREE))
        last, y = q, (vq - centre * q) / half
        for _ in range(degree - 1):
            size = np.linalg.norm(y, axis=0)  # columns are scaled alike in both terms
            last, y = last / size, y / size
            last, y = y, 2 / half * (image(y) - centre * y) - last
        q = np.linalg.qr(y / np.linalg.norm(y, axis=0))[0]
    raise RuntimeError(f"the components did not settle: residual {worst:.3g} of the largest eigenvalue")


# -- the operator -------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What a fit found; its size depends on the width of the vectors alone."""

    scale: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int


def fit_whitening(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """Fit on each distinct gridded vector once; None where no row has a vector.

    Vectors of different widths raise ValueError. The distinct vectors are written once to
    the shared folder, and each pass reads them there; copies collapse before the shuffle.
    """
    fit = stored(gridded(rows, vec_id, vector, scale).select("g").distinct(), "vectors")
    sizes = fit.agg(F.count("*").alias("n"), F.min(F.size("g")).alias("low"), F.max(F.size("g")).alias("high")).first()
    n, width = sizes["n"], sizes["high"]
    if not n:
        return None
    if sizes["low"] != width:
        raise ValueError(f"vector lengths differ: {sizes['low']} and {width}")
    sums = exact_sums(fit, width)
    mean = np.array([s / n for s in sums])

    def apply(y: np.ndarray) -> np.ndarray:
        def part(g: np.ndarray) -> np.ndarray:
            centred = g - mean
            return centred.T @ (centred @ y)

        return summed(fit, width, y.shape[1], part) / n

    trace = float(summed(fit, width, 1, lambda g: ((g - mean) ** 2).sum(axis=0)[:, None]).sum()) / n
    found = leading(apply, width, components) if trace > 0 else Spectrum(np.zeros(0), np.zeros((width, 0)), np.zeros(0), 0)
    k, error = len(found.values), 0.0
    if k:
        project = found.vectors / np.sqrt(found.values)

        def squares(g: np.ndarray) -> np.ndarray:
            w = (g - mean) @ project
            return w.T @ w

        error = float(np.abs(summed(fit, k, k, squares) / n - np.eye(k)).max())
    return Whitening(scale, n, sums, found.values, found.vectors, trace, error, found.passes)


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per row with a vector: vec_id, n, deviation decimal(38,0), whitened array<double>,
    explained array<double>, identity_error.

    Rows whose vector is null or empty, or holds null, infinite or not-a-number entries (or
    ones beyond 2^55, which have no place on the grid), are dropped. Repeated rows and null
    ids stay; other columns are not looked at. Components without variance are left out, so
    the arrays are shorter where the distinct vectors span fewer dimensions, and empty for a
    single one. An empty table gives no rows.

    ``deviation`` is the exact sum over dimensions of (n * x - S)^2 with the sums S of the
    fit list; adding a constant to all x, as some grids do, changes nothing.
    """
    model = fit_whitening(rows, vec_id, vector, components, scale)
    kept = gridded(rows, vec_id, vector, scale)
    kind = rows.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"
    n = model.n if model else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, project = np.array([s / n for s in model.sums]), model.vectors / np.sqrt(model.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            g = matrix(batch)
            # 64 bits hold the sum of squares unless this bound says otherwise.
            most = n * max(abs(int(g.min())), abs(int(g.max()))) + max(map(abs, model.sums))
            exact = np.int64 if most * most * g.shape[1] < 1 << 62 else object
            gaps = n * g.astype(exact) - np.array(model.sums, dtype=exact)
            deviation = pa.array((gaps * gaps).sum(axis=1).tolist(), pa.decimal128(38, 0))
            white = (g - mean) @ project
            offsets = np.arange(0, white.size + 1, white.shape[1], dtype=np.int32) if white.shape[1] else np.zeros(len(g) + 1, dtype=np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], names=["vec_id", "deviation", "whitened"])

    if not model:
        out = rows.sparkSession.createDataFrame([], schema)
        explained, error = [], 0.0
    else:
        out = kept.mapInArrow(run, schema)
        explained, error = [float(v / model.trace) for v in model.values], model.identity_error
    return out.select(
        "vec_id",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_chebyshev_whitening(spark, sf_dir):
    """A row per vector and component; a deviation that does not fit a long raises."""
    white = whiten(table(spark, sf_dir, "embeddings"))
    each = white.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.element_at("explained", F.col("at") + 1).alias("explained"),
        "identity_error",
    )
