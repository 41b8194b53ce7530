"""Cross-products of residuals, and sums that hold the score moments of all models."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speccurve.operators.scale import sum_arrays

# Bytes of score moments one task may hold, and values of one product inside it.
MOMENT_BYTES = 64 << 20
CHUNK_VALUES = 4_000_000
# Sums that still fit one compiled aggregation.
COMPILED_SUMS = 100


def gram_matrices(rows: DataFrame, n_vars: int) -> dict[int, np.ndarray]:
    """Cross-products of ``v0..`` per sample.

    Few variables: plain sums, compiled by Spark.  Many: each task adds up its
    Arrow batches first.  Either way the sums per sample (samples of a wave
    times variables squared) come to the driver.
    """
    row, col = triangle(n_vars)
    names = [f"g{i}" for i in range(len(row))]
    if len(row) <= COMPILED_SUMS:
        total = cluster_grams(rows, [], n_vars)
    else:
        values = [f"v{j}" for j in range(n_vars)]

        def partial(batches):
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                sids, data = _matrix(batch, values)
                for sid in np.unique(sids):
                    part = data[sids == sid]
                    totals[int(sid)] = totals.get(int(sid), 0.0) + part.T @ part
            for sid, total in totals.items():
                yield _record({"sid": np.array([sid])}, total[row, col][None, :], names)

        schema = "sid long, " + ", ".join(f"{n} double" for n in names)
        parts = rows.select("sid", *values).mapInArrow(partial, schema)
        total = parts.groupBy("sid").agg(*[F.sum(n).alias(n) for n in names])
    out = {}
    for found in total.collect():
        gram = np.zeros((n_vars, n_vars))
        gram[row, col] = gram[col, row] = [found[n] for n in names]
        out[found["sid"]] = gram
    return out


def _record(keys: dict[str, np.ndarray], values: np.ndarray, names) -> pa.RecordBatch:
    columns = {k: pa.array(v, pa.int64()) for k, v in keys.items()}
    columns.update({n: pa.array(values[:, i], pa.float64()) for i, n in enumerate(names)})
    return pa.RecordBatch.from_pydict(columns)


def _matrix(batch, values):
    data = np.column_stack([batch.column(v).to_numpy(zero_copy_only=False) for v in values])
    return batch.column("sid").to_numpy(), data


def triangle(size: int):
    return np.triu_indices(size)


def cluster_grams(rows: DataFrame, keys: list[str], n_vars: int) -> DataFrame:
    """Cross-products per cluster: partial sums before the shuffle, so a
    cluster holding most rows costs no task more than its share."""
    row, col = triangle(n_vars)
    return rows.groupBy("sid", *keys).agg(
        *[F.sum(F.col(f"v{a}") * F.col(f"v{b}")).alias(f"g{i}")
          for i, (a, b) in enumerate(zip(row, col))]
    )


def tensor_batch(keys: dict[str, int], total: np.ndarray) -> pa.RecordBatch:
    """A matrix as one record per row."""
    height, width = total.shape
    columns = {k: pa.array(np.full(height, v), pa.int64()) for k, v in keys.items()}
    columns["row"] = pa.array(np.arange(height), pa.int64())
    columns["part"] = pa.ListArray.from_arrays(
        pa.array(np.arange(height + 1) * width, pa.int32()), pa.array(total.ravel())
    )
    return pa.RecordBatch.from_pydict(columns)


def _squares(kind: int, size: int, names: list[str], flat_of) -> callable:
    """Adds up, per sample, the products of any two cross-products of a row."""

    def partial(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            sids, data = _matrix(batch, names)
            for sid in np.unique(sids):
                part = data[sids == sid]
                total = totals.setdefault(int(sid), np.zeros((size, size)))
                step = max(1, CHUNK_VALUES // size)
                for at in range(0, len(part), step):
                    flat = flat_of(part[at : at + step])
                    total += flat.T @ flat
            if len(totals) * size * size * 8 > MOMENT_BYTES:
                for sid, total in totals.items():
                    yield tensor_batch({"sid": sid, "kind": kind}, total)
                totals = {}
        for sid, total in totals.items():
            yield tensor_batch({"sid": sid, "kind": kind}, total)

    return partial


TENSOR_SCHEMA = "sid long, kind long, row long, part array<double>"


def score_tensors(
    rows: DataFrame, kinds: dict[int, list[str]], n_vars: int, n_samples: int
) -> DataFrame:
    """sid, kind, row, part: the matrix of sums over clusters of products of two
    cross-products, row by row.

    A model's score in a cluster is linear in the cluster's cross-products, so
    these sums hold the score moments of every model of the sample: no task
    knows any model.  ``kinds`` maps a number to the cluster columns; in kind 0
    every row is a cluster of its own.
    """
    row, col = triangle(n_vars)
    union = None
    for kind, keys in kinds.items():
        if kind == 0:
            names = [f"v{j}" for j in range(n_vars)]
            source = rows.select("sid", *names)
            work = _squares(kind, len(row), names, lambda x: x[:, row] * x[:, col])
        else:
            names = [f"g{i}" for i in range(len(row))]
            source = cluster_grams(rows, keys, n_vars).select("sid", *names)
            work = _squares(kind, len(row), names, lambda x: x)
        one = source.mapInArrow(work, TENSOR_SCHEMA)
        union = one if union is None else union.unionByName(one)
    return sum_arrays(union, ["sid", "kind", "row"], "part")


def score_loads(
    kept: np.ndarray, yi: int, beta: np.ndarray, n_vars: int, mean: np.ndarray | None
) -> np.ndarray:
    """The scores of a model as combinations of cross-products: kept regressors
    x entries of the triangle.

    With ``mean``, the cross-products are those of a constant and the variables,
    and the scores those of the variables without their mean.
    """
    first = 0 if mean is None else 1
    size = n_vars + first
    left = np.zeros((len(kept), size))
    left[np.arange(len(kept)), kept + first] = 1.0
    weight = np.zeros(size)
    weight[yi + first] = 1.0
    weight[kept + first] -= beta
    if mean is not None:
        left[:, 0] = -mean[kept]
        weight[0] = -(mean @ weight[1:])
    row, col = triangle(size)
    return left[:, row] * weight[col] + np.where(row != col, left[:, col] * weight[row], 0.0)


def model_moments(
    models: pd.DataFrame, tensors: dict[int, np.ndarray], n_vars: int, mean: np.ndarray | None
) -> tuple[list, list]:
    """For every model of one sample: its kinds, and for each the upper triangle
    of its score moments."""
    loads = [
        score_loads(np.asarray(k, int), yi, np.asarray(b, float), n_vars, mean)
        for yi, k, b in zip(models["yi"], models["kept"], models["beta"])
    ]
    ends = np.cumsum([len(x) for x in loads])
    stacked = np.vstack(loads)
    parts: list[list] = [[] for _ in loads]
    for total in tensors.values():
        half = stacked @ total
        for i, (load, end) in enumerate(zip(loads, ends)):
            parts[i].append((half[end - len(load) : end] @ load.T)[triangle(len(load))])
    return [list(tensors)] * len(loads), parts
