"""Whitening of vectors by exact integer covariances, found from squares alone.

For any two dimensions the variance of their sum is the sum of both variances and twice their
covariance. So the only things added up over the corpus are squares of centred values, for every
dimension and for every sum of two dimensions; differences of these variances are the covariances.
All of it is integer arithmetic, so no order of summation and no large mean costs a digit.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hoardbook.llm.common import extended

SCALE, SHIFT = 64, 1_000_000
_WIDE = pa.decimal128(38, 0)
_LIMB = 80  # bits; sums of squares travel as two numbers, so that they fit whatever the entries
_LONG = (1 << 63) - 1
ROWS_AT_ONCE = 4_096


@dataclass
class Whitening:
    """What whitens vectors of one length: how many were fitted, their sums per dimension, the
    eigenvalues (falling) and unit eigenvectors (columns) of their covariance, its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def middle(self) -> np.ndarray:
        """Per dimension the whole number nearest to the mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def scaled(self, top: int) -> np.ndarray:
        """The first components over the root of their eigenvalue; not a number where that is 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(self.values[:top])
            return np.where(root > 0, self.vectors[:, :top] / root, np.nan)


def whole_numbers(vectors: list, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """floor(scale * c) + shift for each entry, as long; beyond 2^61 either way, that number."""
    m = np.floor(np.asarray(vectors, np.float64) * scale)
    inside = np.clip(m, -(2.0**61), 2.0**61)
    return inside.astype(np.int64) + shift


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor empty and holds finite numbers only."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where((F.size(vector) > 0) & finite)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Blocks of rows with vectors of one length: their places in the batch, numbers, the batch."""
    for batch in batches:
        column = batch.column("_vector")
        sizes = np.diff(column.offsets.to_numpy())
        flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for some in np.array_split(at, -(-len(at) // ROWS_AT_ONCE)):
                yield some, whole_numbers(flat[starts[some][:, None] + np.arange(size)]), batch


def _exact(block: np.ndarray, most: int) -> np.ndarray:
    """As long where sums of ``most`` squares of sums of two entries fit, else as Python's integers."""
    top = int(max(-block.min(), block.max(), 1))
    return block if 4 * top * top * most < 1 << 62 else block.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per vector length and dimension of a task's rows: their number and the sum."""
    held: dict[int, list] = {}
    for _, x, _ in _by_length(batches):
        n, s = held.get(x.shape[1], (0, 0))
        held[x.shape[1]] = [n + len(x), s + _exact(x, len(x)).sum(0).astype(object)]
    yield pa.RecordBatch.from_arrays([
        pa.array([d for d in held for _ in range(d)], pa.int32()),
        pa.array([i for d in held for i in range(d)], pa.int32()),
        pa.array([held[d][0] for d in held for _ in range(d)], pa.int64()),
        pa.array([int(v) for d in held for v in held[d][1]], _WIDE),
    ], ["dims", "i", "n", "s"])


def _squares(middles: dict[int, np.ndarray]):
    """Per vector length and dimension or pair of them (i <= j; i = j for one dimension alone) of a
    task's rows: the sum of squares of entry i, or of entries i and j together, less the middles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for _, x, _ in _by_length(batches):
            d = x.shape[1]
            y = _exact(x - middles[d], len(x))
            total = held.setdefault(d, [0] * d)
            for i in range(d):
                pair = y[:, i:] + y[:, i:i + 1]
                pair[:, 0] = y[:, i]
                total[i] = total[i] + (pair * pair).sum(0).astype(object)
        rows = [
            (d, i, i + k, int(v) >> _LIMB, int(v) & ((1 << _LIMB) - 1))
            for d in held for i in range(d) for k, v in enumerate(held[d][i])
        ]
        kinds = (pa.int32(), pa.int32(), pa.int32(), _WIDE, _WIDE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, kinds)], ["dims", "i", "j", "high", "low"]
        )

    return run


def fit(vectors: DataFrame, vector: str = "embedding") -> dict[int, Whitening]:
    """Per vector length the whitening of all usable rows of ``vectors``.

    Two passes over the vectors, each leaving one row per task and pair of dimensions, added up
    before and after a shuffle. The driver gets d (d + 3) / 2 numbers for each length d there is,
    whatever the number of rows.
    """
    rows = usable(vectors, vector).select(F.col(vector).cast("array<double>").alias("_vector"))
    sums = rows.mapInArrow(_sums, "dims int, i int, n bigint, s decimal(38,0)").groupBy("dims", "i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")
    ).collect()
    per = {}
    for r in sorted(sums, key=lambda r: (r["dims"], r["i"])):
        per.setdefault(r["dims"], (r["n"], []))[1].append(int(r["s"]))
    models = {d: Whitening(n, s, np.zeros(d), np.eye(d), 0.0) for d, (n, s) in per.items()}
    squares = rows.mapInArrow(
        _squares({d: m.middle for d, m in models.items()}), "dims int, i int, j int, high decimal(38,0), low decimal(38,0)"
    ).groupBy("dims", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    found = {(r["dims"], r["i"], r["j"]): (int(r["high"]) << _LIMB) + int(r["low"]) for r in squares}
    for d, model in models.items():
        n = model.n
        rest = [s - n * int(m) for s, m in zip(model.sums, model.middle)]
        # n times the squares less the squared rest is n * n times the variance, exactly.
        alone = [n * found[d, i, i] - rest[i] ** 2 for i in range(d)]
        spread = np.empty((d, d))
        for i in range(d):
            for j in range(i, d):
                both = alone[i] if i == j else (
                    n * found[d, i, j] - (rest[i] + rest[j]) ** 2 - alone[i] - alone[j]
                ) // 2
                spread[i, j] = spread[j, i] = both / (n * n)
        values, directions = np.linalg.eigh(spread)
        values, directions = values[::-1].copy(), directions[:, ::-1].copy()
        values[values <= max(values[0], 0) * d * np.finfo(float).eps] = 0
        lead = directions[np.abs(directions).argmax(0), np.arange(d)]
        model.values, model.vectors = values, directions * np.where(lead < 0, -1, 1)
        model.trace = sum(alone) / (n * n)
    return models


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """x less the mean, in double precision without losing digits to a large mean."""
    rest = [s - model.n * int(m) for s, m in zip(model.sums, model.middle)]
    return (x - model.middle).astype(np.float64) - np.array([r / model.n for r in rest])


def _grams(models: dict[int, Whitening], top: int):
    """Per vector length and pair of components: the sum of products of a task's whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for _, x, _ in _by_length(batches):
            d = x.shape[1]
            w = _centred(x, models[d]) @ models[d].scaled(top)
            held[d] = held.get(d, 0) + w.T @ w
        rows = [(d, a, b, float(m[a, b])) for d, m in held.items() for a in range(len(m)) for b in range(a, len(m))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.float64()))],
            ["dims", "a", "b", "g"],
        )

    return run


def identity_errors(
    vectors: DataFrame, models: dict[int, Whitening], vector: str = "embedding", top: int = 32
) -> dict[int, float]:
    """Per vector length the largest absolute entry of the covariance of the whitened rows less the
    identity, taken over all rows; components without variance are left out."""
    rows = usable(vectors, vector).select(F.col(vector).cast("array<double>").alias("_vector"))
    sums = rows.mapInArrow(_grams(models, top), "dims int, a int, b int, g double").where(
        ~F.isnan("g")
    ).groupBy("dims", "a", "b").agg(F.sum("g").alias("g")).collect()
    errors: dict[int, float] = {}
    for r in sums:
        off = abs(r["g"] / models[r["dims"]].n - (r["a"] == r["b"]))
        errors[r["dims"]] = max(errors.get(r["dims"], 0.0), off)
    return errors


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over the dimensions of (n * x - S) squared; none where that is no long."""
    rest = np.array([s - model.n * int(m) for s, m in zip(model.sums, model.middle)], object)
    y = x - model.middle
    top = int(max(-y.min(), y.max(), 1)) * model.n + model.n
    t = y * model.n - rest.astype(np.int64) if top * top * x.shape[1] < 1 << 62 else y.astype(object) * model.n - rest
    return [int(v) if v <= _LONG else None for v in (t * t).sum(1)]


def _whitened(models: dict[int, Whitening], top: int):
    scaled = {d: m.scaled(top) for d, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, x, batch in _by_length(batches):
            model = models[x.shape[1]]
            w = _centred(x, model) @ scaled[x.shape[1]]
            taken = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names).take(pa.array(at))
            flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [*taken.columns[:-1], pa.array(_deviations(x, model), pa.int64()), lists,
                 pa.array([x.shape[1]] * len(x), pa.int32())],
                [*taken.schema.names[:-1], "deviation", "whitened", "dims"],
            )

    return run


def whiten(
    vectors: DataFrame, models: dict[int, Whitening], key: str = "vec_id", vector: str = "embedding",
    top: int = 32,
) -> DataFrame:
    """Per usable row of ``vectors``: its key, deviation, whitened (an array, one number for each of
    the first ``top`` components) and dims, its vector's length."""
    rows = usable(vectors, vector).select(
        F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_vector")
    )
    schema = extended(rows.select("_id"), "deviation bigint, whitened array<double>, dims int")
    return rows.mapInArrow(_whitened(models, top), schema).withColumnRenamed("_id", key)


def whitened_components(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 32
) -> DataFrame:
    """One row per usable row of ``vectors`` and component up to ``top``: the key, component, n,
    deviation, whitened, explained and identity_error.

    Rows whose vector is null or empty or holds null or non-finite entries are left out. Each other
    entry becomes floor(64 * entry) + 1000000 (beyond 2^61 either way, that number). Vectors of different lengths have a fit each, with
    its own n. A component without variance (all vectors equal, or fewer vectors than dimensions)
    has null for whitened, and for explained if nothing varies; eigenvalues of one size may come in
    any order. A deviation beyond a long is null. Null, equal and repeated keys are rows like any
    other; other columns may bear any name; an empty table gives no rows. Four passes over the
    vectors, none of which moves a row.
    """
    models = fit(vectors, vector)
    errors = identity_errors(vectors, models, vector, top)
    kind = vectors.schema[key].dataType.simpleString()
    facts = [
        (d, c + 1, m.n, float(m.values[c]) / m.trace if m.trace > 0 else None, errors.get(d))
        for d, m in models.items() for c in range(min(top, d))
    ]
    facts = vectors.sparkSession.createDataFrame(
        facts, "dims int, component int, n bigint, explained double, identity_error double"
    )
    rows = whiten(vectors, models, key, vector, top).select(
        F.col(key).cast(kind).alias("_id"), "deviation", "dims", F.posexplode("whitened").alias("_place", "whitened")
    )
    return rows.withColumn("component", (F.col("_place") + 1).cast("int")).join(
        F.broadcast(facts), ["dims", "component"]
    ).select(
        F.col("_id").alias(key), "component", "n", "deviation", "whitened", "explained", "identity_error"
    )
