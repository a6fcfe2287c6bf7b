"""Ridge studies from sums of products.

A study fits many ridge models on overlapping parts of one table: folds, seeds, fractions, feature
sets, targets. All of them follow from the sums of products of the columns, taken once for each
disjoint part: every Arrow batch is one matrix product for each part that it holds, a task hands on one partial
matrix for each part, and a second stage adds these up by part and row. Parts are a design of bounded size (folds by
seeds, bins by seeds), so their matrices fit the driver, where unions of parts are sums and the small systems are solved.
R², RMSE, bias and correlation of a model on a part follow from its matrix too; absolute errors
take one more pass, in which all models together are one matrix product for each batch.

Rows with a NULL, NaN or infinite value in any of the columns don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _values(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``width`` columns with a leading one, whole rows only; and which rows these are."""
    x = np.ones((batch.num_rows, width + 1))
    for i in range(width):
        x[:, i + 1] = np.asarray(batch.column(i).fill_null(float("nan")))
    good = np.isfinite(x).all(1)
    return x[good], good


def _parts(batch: pa.RecordBatch, at: int, good: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """(part, its rows among the good ones) of a column of parts; rows without a part are in none."""
    codes = batch.column(at).dictionary_encode()
    index = np.asarray(codes.indices.fill_null(-1))[good]
    for i, value in enumerate(codes.dictionary.to_pylist()):
        if len(rows := np.flatnonzero(index == i)):
            yield value, rows


def _ready(df: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], *[F.col(c).cast("string").alias(f"p{i}") for i, c in enumerate(parts)])


def gram_rows(df: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    """(grouping, part, i, sums): row i of the matrix of sums of products of (1, columns) for every value of each of the ``parts`` columns."""
    width = len(columns)

    def multiply(batches):
        found: dict[tuple[int, str], np.ndarray] = {}
        for b in batches:
            x, good = _values(b, width)
            for g in range(len(parts)):
                for part, rows in _parts(b, width + g, good):
                    own = x[rows]
                    found[g, part] = found.get((g, part), 0) + own.T @ own
        yield from _rows(found)

    def add(batches):
        total: dict[tuple[int, str, int], np.ndarray] = {}
        for b in batches:
            sums = np.asarray(b.column(3).flatten()).reshape(b.num_rows, width + 1)
            for key, row in zip(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True), sums, strict=True):
                total[key] = total.get(key, 0) + row
        if total:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*total, strict=True), _KEY, strict=True)), pa.array(list(total.values()), pa.list_(pa.float64()))], names=_NAMES)

    # The partial rows of one (part, i) meet in one task, which holds a row for each of its keys and no more.
    return _ready(df, columns, parts).mapInArrow(multiply, _SCHEMA).repartition("grouping", "part", "i").mapInArrow(add, _SCHEMA)


_SCHEMA, _NAMES = "grouping int, part string, i int, sums array<double>", ["grouping", "part", "i", "sums"]
_KEY = (pa.int32(), pa.string(), pa.int32())


def _rows(found: dict[tuple[int, str], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (g, part), m in found.items():
        n = len(m)
        yield pa.RecordBatch.from_arrays([pa.array([g] * n, pa.int32()), pa.array([part] * n), pa.array(range(n), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=_NAMES)


def gram_matrices(df: DataFrame, columns: list[str], parts: list[str]) -> list[dict[str, np.ndarray]]:
    """For each of the ``parts`` columns its values' matrices."""
    out: list[dict[str, np.ndarray]] = [{} for _ in parts]
    size = len(columns) + 1
    for r in gram_rows(df, columns, parts).toLocalIterator():
        out[r.grouping].setdefault(r.part, np.zeros((size, size)))[r.i] = r.sums
    return out


def ridge_weights(m: np.ndarray, features: list[int], target: int, alpha: float = 1.0) -> np.ndarray:
    """Weights over all columns of the matrix, the intercept first and 0 for unused ones; the intercept is not penalised."""
    n = m[0, 0]
    x, y = m[0, features], m[0, target]
    w = np.zeros(len(m))
    w[features] = np.linalg.solve(m[np.ix_(features, features)] - np.outer(x, x) / n + alpha * np.eye(len(features)), m[features, target] - x * y / n)
    w[0] = (y - w[features] @ x) / n
    return w


def metrics_of(m: np.ndarray, w: np.ndarray, target: int) -> dict[str, float | None]:
    """n, r2, rmse, bias and pearson_r of the predictions that weights make on a part; NULL where undefined."""
    n = m[0, 0]
    if n == 0:
        return {"n": 0, "r2": None, "rmse": None, "bias": None, "pearson_r": None}
    error = w.copy()
    error[target] -= 1
    sse = max(float(error @ m @ error), 0.0)
    spread = lambda v: max(float(v @ m @ v - (m[0] @ v) ** 2 / n), 0.0)
    unit = np.eye(len(m))[target]
    sst, ssp = spread(unit), spread(w)
    both = float(unit @ m @ w - (m[0] @ unit) * (m[0] @ w) / n)
    tiny = 1e-12 * max(float(m[target, target]), 1.0)
    return {
        "n": int(n),
        "r2": 1 - sse / sst if sst > tiny else None,
        "rmse": float(np.sqrt(sse / n)),
        "bias": float(m[0] @ error / n),
        "pearson_r": both / float(np.sqrt(sst * ssp)) if sst > tiny and ssp > tiny else None,
    }


@dataclass(frozen=True)
class Case:
    """A model whose absolute errors on one part are wanted."""

    grouping: int
    part: str
    target: int
    weights: tuple[float, ...]


def absolute_errors(df: DataFrame, columns: list[str], parts: list[str], cases: list[Case]) -> list[float | None]:
    """The mean absolute error of each case, from one pass over the rows; NULL for a part without rows."""
    width = len(columns)
    by_part: dict[tuple[int, str], list[int]] = {}
    for k, c in enumerate(cases):
        by_part.setdefault((c.grouping, c.part), []).append(k)
    held = df.sparkSession.sparkContext.broadcast((by_part, np.array([c.weights for c in cases]).T if cases else np.zeros((width + 1, 0)), np.array([c.target for c in cases], int)))

    def run(batches):
        by_part, weights, targets = held.value
        total, n = np.zeros(len(targets)), np.zeros(len(targets), np.int64)
        for b in batches:
            x, good = _values(b, width)
            for g in range(len(parts)):
                for part, rows in _parts(b, width + g, good):
                    if own := by_part.get((g, part)):
                        total[own] += np.abs(x[rows] @ weights[:, own] - x[rows][:, targets[own]]).sum(0)
                        n[own] += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(total), pa.array(n)], names=["case", "total", "n"])

    sums = _ready(df, columns, parts).mapInArrow(run, "case int, total double, n long").groupBy("case").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    found = {r["case"]: r["total"] / r["n"] for r in sums.toLocalIterator() if r["n"]}
    return [found.get(k) for k in range(len(cases))]


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all column pairs a before b; NULL if either is constant."""
    (found,) = gram_matrices(df.withColumn("_all", F.lit("all")), columns, ["_all"])
    rows = []
    for m in found.values():
        spread = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0]
        size = np.sqrt(np.diag(spread).clip(0))
        flat = size**2 <= 1e-12 * np.diag(m)[1:].clip(1e-300)
        rows = [(a, b, None if flat[i] or flat[j] else float(spread[i, j] / (size[i] * size[j]))) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
