"""Factors of one tall matrix whose rows are arrays of n numbers: a tree of small factors, so no task holds more than two of n x n.

Every task reduces its rows to one triangular factor, batch by batch; factors are reduced some at a time until one is
left. Unlike sums of products, this doesn't square the condition of the matrix. Rows are real numbers; one that isn't n
numbers is an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FactorizationError
from ..sources.storage import stored
from .contract import vectors, whole_rows

#: Factors that one task of the tree reduces to one.
FAN = 16


def triangle(x: np.ndarray, n: int) -> np.ndarray:
    """The triangular factor with a diagonal that isn't negative; fewer rows than n are filled up with zeros."""
    r = np.linalg.qr(np.vstack([x, np.zeros((max(0, n - len(x)), n))]), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def reduced(df: DataFrame, n: int) -> DataFrame:
    """id and r: one factor (row by row) for each partition of a table whose last column has n numbers a row, or whole factors."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        r, any_ = np.zeros((0, n)), False
        for batch in batches:
            x = vectors(batch.column(batch.num_columns - 1), n)
            if len(x):
                r, any_ = triangle(np.vstack([r, x]), n), True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["id", "r"])

    return df.mapInArrow(run, "id bigint, r array<double>")


def r_factor(x: DataFrame, n: int) -> np.ndarray:
    """The n x n factor R of the rows in the only column of x; zeros without rows."""
    parts = stored(reduced(x, n), "factors")
    count = parts.count()
    while count > 1:
        m = -(-count // FAN)
        parts = stored(reduced(parts.repartition(m, F.col("id") % m), n), "factors")
        count = parts.count()
    got = parts.first()
    return np.array(got["r"]).reshape(n, n) if got else np.zeros((n, n))


def times(rows: DataFrame, key: str, column: str, n: int, *small: np.ndarray, name: str = "q") -> DataFrame:
    """key and name: every row times the small matrices, one after the other, without a shuffle."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = vectors(batch.column(1), n)
            for m in small:
                x = x @ m
            ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel()))], [key, name])

    return rows.select(key, whole_rows(column, n).alias(column)).mapInArrow(run, f"{key} {kind}, {name} array<double>")


def orthonormal(rows: DataFrame, key: str, column: str, n: int) -> tuple[DataFrame, list[np.ndarray], np.ndarray]:
    """An orthonormal basis of the columns: (key, q), the small matrices that make it of the rows, and the singular values.

    Rows are multiplied by the right vectors over the values of their factor, and what rounding left of their products is
    divided out by a second factor. Directions below n rounding errors of the largest value are left out.
    """
    r = r_factor(rows.select(whole_rows(column, n)), n)
    _, s, vt = np.linalg.svd(r)
    keep = s > n * np.finfo(float).eps * max(s[0], np.finfo(float).tiny)
    if not keep.any():
        raise FactorizationError("a matrix of zeros has no basis")
    first = vt[keep].T / s[keep]
    q = times(rows, key, column, n, first)
    again = np.linalg.inv(r_factor(q.select("q"), int(keep.sum())))
    return times(rows, key, column, n, first, again), [first, again], s[keep]


def tall_qr(rows: DataFrame, key: str, column: str, n: int) -> tuple[DataFrame, np.ndarray]:
    """Q as rows (key, q array) and R, n x n with a positive diagonal, of a matrix of full rank.

    Q is the rows times the inverse of a first factor, and times the inverse of the factor of that, so its columns are
    orthonormal to rounding up to a condition of 10^15 or so; beyond it, a matrix counts as of less than full rank, which is
    an error, as is one of fewer rows than n.
    """
    first = r_factor(rows.select(whole_rows(column, n)), n)
    size = np.linalg.norm(first, axis=0)
    if (np.abs(np.diag(first)) <= n * np.finfo(float).eps * size).any() or not np.isfinite(first).all():
        raise FactorizationError("the columns depend on each other")
    one = np.linalg.inv(first)
    second = r_factor(times(rows, key, column, n, one).select("q"), n)
    return times(rows, key, column, n, one, np.linalg.inv(second)), second @ first


def wide_lq(columns: DataFrame, key: str, column: str, n: int) -> tuple[np.ndarray, DataFrame]:
    """L (n x n, a positive diagonal) and Q's columns (key, q array) of a wide matrix of n rows, stored by its columns."""
    q, r = tall_qr(columns, key, column, n)
    return r.T, q


def tall_svd(rows: DataFrame, key: str, column: str, n: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Left vectors (key, u array), values and right vectors, without values below n rounding errors of the largest."""
    r = r_factor(rows.select(whole_rows(column, n)), n)
    _, s, vt = np.linalg.svd(r)
    keep = s > n * np.finfo(float).eps * max(s[0], np.finfo(float).tiny)
    v = vt[keep].T
    return times(rows, key, column, n, v / s[keep], name="u"), s[keep], v
