"""Embedding whitening from polarised covariances.

1. Entries become integers, x = floor(scale * c). The fit list holds every
   distinct vector of integers once: equal vectors are combined before they
   move, so a vector that fills a third of the table is one row per task.
2. A first pass over the list gives its size n and the exact sums S.
3. A second pass centres every entry at the integer next to its mean and adds
   up exact squares, of every dimension and of the sum of every two
   dimensions. With the rest of the centring taken off exactly, the squares are
   variances, and cov(i, j) = (var(i + j) - var(i) - var(j)) / 2: the
   covariances are exact fractions until they become doubles for `eigh`.
4. A third pass measures the covariance of the whitened list itself.

Tasks pass on one number per dimension or pair of dimensions, never rows; the
driver holds the d * d covariance. Integers that could pass 64 bits are added
up as big integers.

Defined cases: vectors that are null, empty or hold null or non-finite
entries take no part and are not returned; repeated rows are each returned;
an entry beyond 64 bits stays at the bound; a table without vectors gives no rows;
directions in which the list doesn't vary (all of them, for one distinct
vector) are no components; a `deviation` beyond 38 digits is null; extra columns
stay, a column named like a result is replaced. Vectors of different lengths are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wishloom.llm.arrowmap import append, pieces, tidy
from wishloom.plans.scale import scratch_folder

X = "_x"
BOUND = 1 << 62


def _usable(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """Rows that take part, with their integers."""
    v = F.col(f"`{vector}`")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False))).withColumn(X, F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("bigint")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pc.unique(pc.list_value_length(column))
    if len(lengths) > 1:
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), -1)


def _fits(largest: int, terms: int) -> bool:
    return largest * max(terms, 1) < BOUND


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _totals(fit: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact totals over all rows of what `work` gives per batch (an array of integers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in (p for b in batches for p in pieces(b)):
            made = work(matrix(batch.column(0))).astype(object)
            total = made if total is None else total + made
        if total is not None:
            # two halves keep every sum of tasks inside a decimal
            yield pa.RecordBatch.from_pydict({
                "k": pa.array(np.arange(len(total)), pa.int32()),
                "high": pa.array([Decimal(int(t) >> 64) for t in total], pa.decimal128(38, 0)),
                "low": pa.array([Decimal(int(t) & ((1 << 64) - 1)) for t in total], pa.decimal128(38, 0))})

    parts = fit.select(X).mapInArrow(tidy(run), "k int, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("k").collect()
    return [(int(r.high) << 64) + int(r.low) for r in rows]


def _sums(x: np.ndarray) -> np.ndarray:
    """Rows counted, then the sum of every dimension."""
    sums = x.sum(axis=0) if _fits(_largest(x), len(x)) else x.astype(object).sum(axis=0)
    return np.concatenate((np.array([len(x)], object), sums.astype(object)))


def _squares(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """Squares of every centred dimension, then of the sum of every two, row after row of the triangle."""
    wide = not _fits(_largest(x) + max(map(abs, middle)), 1)
    z = x.astype(object) - np.array(middle, object) if wide else x - np.array(middle, np.int64)
    if not wide and not _fits(4 * _largest(z) ** 2, len(z)):
        z = z.astype(object)
    alone = (z * z).sum(axis=0)
    pairs = [((z[:, i:i + 1] + z[:, i + 1:]) ** 2).sum(axis=0) for i in range(z.shape[1] - 1)]
    return np.concatenate((alone, *pairs))


def fit(df: DataFrame, vector: str = "embedding", components: int = 4, scale: int = 256) -> dict | None:
    """Size, sums, components and the measured error of the whitening; None without vectors."""
    spark = df.sparkSession
    folder = f"{scratch_folder(spark, 'whitening')}/distinct"
    _usable(df, vector, scale).select(X).distinct().write.parquet(folder)
    distinct = spark.read.parquet(folder)
    totals = _totals(distinct, _sums)
    if not totals:
        return None
    n, sums = totals[0], totals[1:]
    d = len(sums)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    squares = _totals(distinct, lambda x: _squares(x, middle))
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    # n * n times the variance of a dimension, and of the sum of two
    alone = [n * q - r * r for q, r in zip(squares[:d], rest, strict=True)]
    covariance, at = np.zeros((d, d)), d
    for i in range(d):
        covariance[i, i] = alone[i] / (n * n)
        for j in range(i + 1, d):
            both = n * squares[at] - (rest[i] + rest[j]) ** 2
            covariance[i, j] = covariance[j, i] = (both - alone[i] - alone[j]) / (2 * n * n)
            at += 1
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > max(values.max(), 0) * d * np.finfo(float).eps]
    model = {"n": n, "sums": sums, "scale": scale, "values": values[order], "vectors": vectors[:, order],
             "explained": [float(v) / (sum(alone) / (n * n)) for v in values[order]]}
    return model | {"identity_error": _identity_error(distinct, model)}


def _centred(x: np.ndarray, model: dict) -> np.ndarray:
    """n * x - S, exactly."""
    n, sums = model["n"], model["sums"]
    if _fits(n * _largest(x) + max(map(abs, sums)), 1):
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _whitened(centred: np.ndarray, model: dict) -> np.ndarray:
    return (centred / model["n"]).astype(float) @ model["vectors"] / np.sqrt(model["values"])


def _identity_error(distinct: DataFrame, model: dict) -> float:
    """Largest entry of the whitened list's covariance minus the identity."""
    k = len(model["values"])
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in (p for b in batches for p in pieces(b)):
            w = _whitened(_centred(matrix(batch.column(0)), model), model)
            sums += w.sum(axis=0)
            products += w.T @ w
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(k + k * k), pa.int32()), "s": np.concatenate((sums, products.ravel()))})

    rows = distinct.select(X).mapInArrow(tidy(run), "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()
    total = np.array([r.s for r in rows]) / model["n"]
    mean, product = total[:k], total[k:].reshape(k, k)
    return float(np.abs(product - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, model: dict | None, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Kept columns of every row that takes part, with `deviation` and `whitened` (one entry per component)."""
    columns = df.columns if keep is None else keep
    taking = _usable(df, vector, model["scale"] if model else 1)

    def work(column: pa.Array) -> list:
        if not len(column):
            return [[], []]
        centred = _centred(matrix(column), model)
        exact = centred if _fits(_largest(centred) ** 2, centred.shape[1]) else centred.astype(object)
        squares = (exact * exact).sum(axis=1)
        return [[Decimal(int(s)) if s < 10 ** 38 else None for s in squares.tolist()], list(_whitened(centred, model))]

    return append(taking.where("true" if model else "false"), [X], columns, "deviation decimal(38,0), whitened array<double>", work)
