"""Self-organising maps: presets, seeded codebooks, the online schedule, distributed nearest units, errors, batch epochs.

A codebook has at most some thousands of units and is always sent to the tasks; rows never move to find their unit.
"""

from __future__ import annotations

import hashlib
import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.config import CANONICAL, FALLBACK, FALLBACK_ROWS, SEED, SIZE_PRESETS, Profile
from gridloom.functions.sampling import exact_rows, seeded_hash
from gridloom.sources.readers import path_exists
from gridloom.sources.writers import read_json, write_json


def preset(n_rows: int) -> dict:
    """Map side, learning rate, radius and iterations by number of rows."""
    for above, side, rate, sigma, iterations in SIZE_PRESETS:
        if n_rows > above:
            return {"som_x": side, "som_y": side, "learning_rate": rate, "sigma": sigma, "iterations": iterations}
    raise ValueError(n_rows)


def batch_size(n_rows: int, n_units: int) -> int:
    """Rows that meet the codebook at once, of which a tenth of the rows, ten thousand and 400 MB of distances are the most."""
    return max(1000, min(int(1e8 // (4 * n_units)), 10_000, n_rows // 10))


def effective_steps(iterations: int, thinning: bool = True) -> list[int]:
    """Iterations that train: with thinning, above 1,000 every tenth is left out but for the last 100."""
    keep = lambda t: not (thinning and iterations > 1000 and t % 10 == 0 and t < iterations - 100)
    return [t for t in range(iterations) if keep(t)]


log = logging.getLogger("gridloom")

@dataclass
class SomModel:
    """Weights (x, y, d); errors are set by training."""

    weights: np.ndarray
    params: dict = field(default_factory=dict)
    quantization_error: float | None = None
    topographic_error: float | None = None

    @property
    def shape(self) -> tuple[int, int]:
        return self.weights.shape[:2]

    @property
    def flat(self) -> np.ndarray:
        return self.weights.reshape(-1, self.weights.shape[2]).astype(np.float64)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        x, y = self.shape
        rows = [(i, j, [float(v) for v in self.weights[i, j]]) for i in range(x) for j in range(y)]
        return spark.createDataFrame(rows, f"i int, j int, w array<{'float' if self.weights.dtype == np.float32 else 'double'}>")

    @classmethod
    def from_frame(cls, codebook: DataFrame, params: dict | None = None) -> SomModel:
        got = codebook.orderBy("i", "j").collect()
        x, y = max(r["i"] for r in got) + 1, max(r["j"] for r in got) + 1
        return cls(np.asarray([r["w"] for r in got]).reshape(x, y, -1), params or {})

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_frame(spark).write.mode("overwrite").parquet(f"{path}/codebook")
        write_json(spark, self.params | {"quantization_error": self.quantization_error, "topographic_error": self.topographic_error}, f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SomModel:
        params = read_json(spark, f"{path}/params")
        out = cls.from_frame(spark.read.parquet(f"{path}/codebook"), params)
        out.quantization_error, out.topographic_error = params.pop("quantization_error"), params.pop("topographic_error")
        return out


def _draw(seed: int, text: str) -> int:
    """`sampling.seeded_hash` of one key."""
    return int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:15], 16)


def initial_weights(x: int, y: int, d: int, seed: int = SEED) -> np.ndarray:
    """Uniform in [-1, 1] by the seeded hash of unit and dimension, each vector of unit length: the same in any engine."""
    draws = np.array([[_draw(seed, f"{k}:{j}") for j in range(d)] for k in range(x * y)], dtype=np.float64)
    w = (draws / 2.0**59 - 1).reshape(x, y, d)
    return w / np.maximum(np.linalg.norm(w, axis=2, keepdims=True), 1e-12)


def nearest(features: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second nearest unit and the first's distance; ties go to the smallest index."""
    return nearest_of((features**2).sum(axis=1)[:, None] - 2 * features @ flat.T + (flat**2).sum(axis=1)[None, :], features, flat)


def nearest_of(square: np.ndarray, features: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`nearest` from the squared distances, which are used up."""
    slack = 1e-9 * (1 + np.abs(square.min(axis=1, keepdims=True)))
    k1 = (square <= square.min(axis=1, keepdims=True) + slack).argmax(axis=1)
    d1 = np.sqrt(((features - flat[k1]) ** 2).sum(axis=1))
    if len(flat) == 1:
        return k1, d1, k1
    square[np.arange(len(k1)), k1] = np.inf
    k2 = (square <= square.min(axis=1, keepdims=True) + slack).argmax(axis=1)
    return k1, d1, k2


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of vectors, dense or sparse, as one matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_struct(column.type):
        of, at, value = _entries(column)
        out = np.zeros((len(column), _size(column)))
        out[of, at] = value
        return out
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _size(column: pa.StructArray) -> int:
    return column.field("size")[0].as_py() if len(column) else 0


def _entries(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of the entries of sparse rows."""
    at, value = column.field("at"), column.field("value")
    lengths = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), lengths), at.flatten().to_numpy(), value.flatten().to_numpy().astype(np.float64)


def _nearest_sparse(column: pa.StructArray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`nearest` of sparse rows: each entry picks its row of the turned codebook, so the work follows the entries."""
    of, at, value = _entries(column)
    norms, own, dots = (flat**2).sum(axis=1), np.zeros(len(column)), np.zeros((len(column), len(flat)))
    np.add.at(own, of, value**2)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
    if len(of):
        dots[of[starts]] = np.add.reduceat(np.ascontiguousarray(flat.T)[at] * value[:, None], starts, axis=0)
    square = own[:, None] - 2 * dots + norms
    slack = 1e-9 * (1 + np.abs(square.min(axis=1, keepdims=True)))
    k1 = (square <= square.min(axis=1, keepdims=True) + slack).argmax(axis=1)
    miss = np.zeros(len(column))
    np.add.at(miss, of, (value - flat[k1[of], at]) ** 2 - flat[k1[of], at] ** 2)
    d1 = np.sqrt(np.maximum(norms[k1] + miss, 0))
    if len(flat) == 1:
        return k1, d1, k1
    square[np.arange(len(k1)), k1] = np.inf
    k2 = (square <= square.min(axis=1, keepdims=True) + slack).argmax(axis=1)
    return k1, d1, k2


def _units(column: pa.Array, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`nearest` of the vectors of a batch, some at a time."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sparse, parts = pa.types.is_struct(column.type), []
    at_once = min(4096, batch_size(1 << 40, len(flat))) // (16 if sparse else 1)
    for at in range(0, len(column), at_once):
        part = column.slice(at, at_once)
        # A slice's fields keep their offsets only through the array's own accessors.
        parts.append(_nearest_sparse(pa.StructArray.from_arrays(part.flatten(), ["size", "at", "value"]), flat) if sparse else nearest(_matrix(part), flat))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (empty, np.zeros(0), empty)


def bmu(df: DataFrame, model: SomModel) -> DataFrame:
    """(_row_id, k1, d1, k2) by blocks of one matrix product; no shuffle. Rows are dense or sparse."""
    sent = df.sparkSession.sparkContext.broadcast(model.flat)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, d1, k2 = _units(b["features"], sent.value)
            yield pa.RecordBatch.from_arrays([b["_row_id"], pa.array(k1, pa.int32()), pa.array(d1), pa.array(k2, pa.int32())], ["_row_id", "k1", "d1", "k2"])

    return df.select(F.col("_row_id").cast("long").alias("_row_id"), "features").mapInArrow(rows, "_row_id long, k1 int, d1 double, k2 int")


def with_units(df: DataFrame, model: SomModel) -> DataFrame:
    """`df` with k1, d1, k2: only the vectors go to Python, the rows' other columns stay where they are; no shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model.flat)

    @F.arrow_udf("struct<k1: int, d1: double, k2: int>")
    def unit(column: pa.Array) -> pa.Array:
        k1, d1, k2 = _units(column, sent.value)
        return pa.StructArray.from_arrays([pa.array(k1, pa.int32()), pa.array(d1), pa.array(k2, pa.int32())], ["k1", "d1", "k2"])

    # Taken as not deterministic, or a filter on what follows from it would find the units a second time.
    return df.withColumn("_unit", unit.asNondeterministic()("features")).select(*df.columns, "_unit.k1", "_unit.d1", "_unit.k2")


def quantization_error(units: DataFrame) -> DataFrame:
    return units.agg(F.avg("d1").alias("quantization_error"))


def topographic_error(units: DataFrame, y: int) -> DataFrame:
    """Share of rows whose two nearest units are not neighbours (8-neighbourhood); exact at any size."""
    cell = lambda k: (F.floor(F.col(k) / y), F.col(k) % y)
    (i1, j1), (i2, j2) = cell("k1"), cell("k2")
    apart = F.greatest(F.abs(i1 - i2), F.abs(j1 - j2)) > 1
    return units.agg(F.avg(apart.cast("double")).alias("topographic_error"))


def step(weights: np.ndarray, row: np.ndarray, rate: float, sigma: float) -> None:
    """One online update: all units move to the row by a Gaussian of their distance from the winner."""
    x, y, _ = weights.shape
    k = int(((weights - row) ** 2).sum(axis=2).argmin())
    i, j = np.indices((x, y))
    pull = rate * np.exp(-((i - k // y) ** 2 + (j - k % y) ** 2) / (2 * sigma**2))
    weights += pull[:, :, None] * (row - weights)


def schedule(df: DataFrame, n_steps: int, seed: int = SEED) -> np.ndarray:
    """The rows that the steps train on, in order: the n_steps smallest seeded hashes, again with the next seed if rows run out.

    Only these rows (steps x dimensions numbers) reach the driver, by one job: where the steps outnumber the rows, the
    driver has them all and orders them anew. A shorter schedule is the start of a longer one.
    """
    got = df.select("_row_id", "features", seeded_hash(F.col("_row_id"), seed).alias("h")).orderBy("h", "_row_id").limit(n_steps).toArrow()
    if not len(got):
        raise ValueError("no rows to train on")
    rows, ids = _matrix(got["features"]), got["_row_id"].to_pylist()
    out, k = [rows], 1
    while k * len(rows) < n_steps:
        out.append(rows[sorted(range(len(ids)), key=lambda i: (_draw(seed + k, str(ids[i])), ids[i]))])
        k += 1
    return np.concatenate(out)[:n_steps]


def decayed(value: float, t: int, steps: int, decay: str = "none") -> float:
    """Rate or radius at step t: constant, falling to a third (`asymptotic`), or falling to nothing (`linear`)."""
    return {"none": value, "asymptotic": value / (1 + 2 * t / steps), "linear": value * (1 - t / steps)}[decay]


def fitted(rows: np.ndarray, params: dict, seed: int = SEED, profile: Profile = CANONICAL, decay: str = "none", samples_per_step: int = 1) -> SomModel:
    """The online updates by the scheduled rows, `samples_per_step` of them at each step's rate and radius."""
    steps = effective_steps(params["iterations"], profile.thinning)
    weights = initial_weights(params["som_x"], params["som_y"], rows.shape[1], seed)
    for n, t in enumerate(steps):
        rate, sigma = (decayed(params[c], t, params["iterations"], decay) for c in ("learning_rate", "sigma"))
        for row in rows[n * samples_per_step : (n + 1) * samples_per_step]:
            step(weights, row, rate, sigma)
    return SomModel(weights.astype(np.float32), params | {"seed": seed})


def completed(df: DataFrame, params: dict) -> dict:
    """Parameters with the unset ones from the `preset` for the number of rows."""
    return dict(params) if None not in params.values() else preset(df.count()) | {k: v for k, v in params.items() if v is not None}


def train(
    df: DataFrame,
    som_x: int | None = None,
    som_y: int | None = None,
    sigma: float | None = None,
    learning_rate: float | None = None,
    iterations: int | None = None,
    seed: int = SEED,
    profile: Profile = CANONICAL,
    decay: str = "none",
    samples_per_step: int = 1,
    method: str = "online",
    epochs: int = 20,
    path: str | None = None,
) -> SomModel:
    """A map of the rows; unset values: `preset`.

    `online`: the sampled rows on the driver, everything that touches all rows in tasks. `batch`: epochs over all rows in
    tasks, see `train_batch`; learning rate and iterations do not matter there.
    """
    params = completed(df, {"som_x": som_x, "som_y": som_y, "sigma": sigma, "learning_rate": learning_rate, "iterations": iterations})
    if method == "batch":
        model = train_batch(df, params, epochs, seed, path=path)
    elif method == "online":
        model = fitted(schedule(df, len(effective_steps(params["iterations"], profile.thinning)) * samples_per_step, seed), params, seed, profile, decay, samples_per_step)
    else:
        raise ValueError(method)
    got = errors(bmu(df, model), model.shape[1])
    model.quantization_error, model.topographic_error = got["quantization_error"], got["topographic_error"]
    return model


def errors(units: DataFrame, y: int) -> dict:
    """Both errors in one pass."""
    cell = lambda k: (F.floor(F.col(k) / y), F.col(k) % y)
    (i1, j1), (i2, j2) = cell("k1"), cell("k2")
    apart = F.greatest(F.abs(i1 - i2), F.abs(j1 - j2)) > 1
    return units.agg(F.avg("d1").alias("quantization_error"), F.avg(apart.cast("double")).alias("topographic_error")).first().asDict()


def out_of_memory(e: Exception) -> bool:
    """Whether Python, or Spark in its message, says so."""
    return isinstance(e, MemoryError) or any(x in str(e) for x in ("OutOfMemoryError", "MemoryError"))


def train_or_fallback(df: DataFrame, **params) -> SomModel:
    """`train`, or the small preset where memory does not suffice."""
    try:
        return train(df, **params)
    except Exception as e:
        if not out_of_memory(e):
            raise
        log.warning("training again on at most %d rows: %s", FALLBACK_ROWS, e)
        return train_fallback(df, params.get("seed", SEED))


def train_fallback(df: DataFrame, seed: int = SEED) -> SomModel:
    """The small preset on at most FALLBACK_ROWS rows."""
    return train(exact_rows(df, FALLBACK_ROWS, seed), **FALLBACK, seed=seed)


#: Sums of tasks that are added up in one place at each of the two levels of the tree.
FAN = 256


def _added(parts: DataFrame, d: int) -> DataFrame:
    zero, plus = F.array_repeat(F.lit(0.0), d), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    return parts.agg(F.aggregate(F.collect_list("total"), zero, plus).alias("total"), F.sum("n").alias("n"))


def batch_sums(df: DataFrame, model: SomModel) -> DataFrame:
    """(k, total array, n): sum and count of the rows of each unit that has any.

    A task sends one array for each unit that it hit; those are added up by a tree of two levels.
    """
    sent, d = df.sparkSession.sparkContext.broadcast(model.flat), model.weights.shape[2]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = sent.value
        total, n = np.zeros_like(flat), np.zeros(len(flat), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b["features"])
                k1, _, _ = _units(b["features"], flat)
                np.add.at(total, k1, x)
                n += np.bincount(k1, minlength=len(flat))
        hit = np.nonzero(n)[0]
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1) * d, pa.int32()), pa.array(total[hit].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), arrays, pa.array(n[hit])], ["k", "total", "n"])

    parts = df.select("features").mapInArrow(rows, "k int, total array<double>, n long").withColumn("branch", F.spark_partition_id() % FAN)
    return _added(_added(parts.groupBy("k", "branch"), d).groupBy("k"), d)


def next_weights(df: DataFrame, model: SomModel, sigma: float) -> np.ndarray:
    """Weights after one epoch: each unit's neighbourhood-weighted mean of all rows; a unit beyond reach of any stays.

    One job; sums of units reach the driver (units x dimensions numbers), where the neighbourhood is one matrix product.
    """
    x, y = model.shape
    got = batch_sums(df, model).toArrow()
    if not len(got):
        raise ValueError("no rows to train on")
    k, n, total = got["k"].to_numpy(), got["n"].to_numpy().astype(np.float64), _matrix(got["total"])
    i, j = np.divmod(np.arange(x * y), y)
    pull = np.exp(-((i[:, None] - i[k]) ** 2 + (j[:, None] - j[k]) ** 2) / (2.0 * sigma * sigma))
    weight = pull @ n
    reached = weight > 0
    out = model.flat.copy()
    out[reached] = (pull @ total)[reached] / weight[reached, None]
    return out.reshape(x, y, -1)


#: The radius shrinks by this factor an epoch, down to the least one.
SHRINK, LEAST_SIGMA = 0.8, 0.5


def train_batch(df: DataFrame, params: dict, epochs: int = 20, seed: int = SEED, tolerance: float = 1e-4, path: str | None = None) -> SomModel:
    """Epochs over all rows, until the largest move of a unit at the least radius is under `tolerance`, `epochs` at most.

    Given a path, the codebook is saved after each epoch, and a run that finds epochs there goes on after the last whole one.
    """
    spark = df.sparkSession
    one = df.select("features").first()
    size = 0 if one is None else one[0]["size"] if isinstance(df.schema["features"].dataType, T.StructType) else len(one[0])
    model, first = SomModel(initial_weights(params["som_x"], params["som_y"], size, seed), params | {"seed": seed, "method": "batch"}), 0
    place = lambda e: f"{path}/epoch-{e:05d}"
    if path:
        while first < epochs and path_exists(spark, f"{place(first)}/params/_SUCCESS"):
            first += 1
        if first:
            saved = SomModel.load(spark, place(first - 1))
            if {k: saved.params.get(k) for k in ("som_x", "som_y", "sigma", "seed")} != {k: model.params[k] for k in ("som_x", "som_y", "sigma", "seed")}:
                raise ValueError(f"{path} holds epochs of other parameters")
            model, moved = SomModel(saved.weights.astype(np.float64), saved.params), saved.params["moved"]
            if saved.params["at_least"] and moved < tolerance:
                first = epochs
    for e in range(first, epochs):
        sigma = max(params["sigma"] * SHRINK**e, min(LEAST_SIGMA, params["sigma"]))
        weights = next_weights(df, model, sigma)
        moved = float(np.sqrt(((weights - model.weights) ** 2).sum(axis=2)).max())
        at_least = math.isclose(sigma, min(LEAST_SIGMA, params["sigma"]))
        model = SomModel(weights, model.params | {"epoch": e, "moved": moved, "at_least": at_least})
        if path:
            model.save(spark, place(e))
        if at_least and moved < tolerance:
            break
    return SomModel(model.weights.astype(np.float32), model.params)


def batch_epoch(df: DataFrame, model: SomModel, sigma: float) -> DataFrame:
    """(k, dim, w): each unit's new weights, the neighbourhood-weighted mean of all rows."""
    flat = next_weights(df, model, sigma).reshape(len(model.flat), -1)
    k, d = np.indices(flat.shape)
    table = pa.table({"k": pa.array(k.ravel(), pa.int32()), "dim": pa.array(d.ravel(), pa.int32()), "w": pa.array(flat.ravel())})
    return df.sparkSession.createDataFrame(table)
