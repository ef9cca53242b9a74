"""Factorizations of many matrices at once: Spark groups the elements of each matrix, numpy factors it in its task.

A table of matrices has columns id, i, j, v. A matrix must fit a task; groups of them are dealt by id, and
every function returns rows, so the number of matrices has no bound. Left and right vectors carry numpy's gauge;
reconstructions and spectra don't depend on it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FactorizationError
from ..functions.prefix import prefix_sums
from ..tensor import Tensor

ENTRY = "id bigint, part string, i bigint, j bigint, v double"


def matrices(t: Tensor, nrow: int, id_axes: int = 0) -> DataFrame:
    """The tensor as matrices: the first id_axes number them, the next nrow axes are rows, the others columns."""
    free = t.shape[id_axes:]
    if not 0 < nrow < len(free):
        raise FactorizationError(f"{nrow} row axes of {len(free)}")

    def flat(names: list[str], shape: tuple[int, ...]):
        at = F.lit(0).cast("bigint")
        for c, n in zip(names, shape):
            at = at * n + F.col(c)
        return at

    a, b = t.axes[id_axes : id_axes + nrow], t.axes[id_axes + nrow :]
    return t.df.select(flat(t.axes[:id_axes], t.shape[:id_axes]).alias("id"), flat(a, free[:nrow]).alias("i"), flat(b, free[nrow:]).alias("j"), F.col("v").cast("double").alias("v"))


def dense(pdf: pd.DataFrame, m: int, n: int) -> np.ndarray:
    a = np.zeros((m, n))
    a[pdf["i"], pdf["j"]] = pdf["v"]
    return a


#: Elements of the matrices that a task factors at once.
STACK = 1 << 20


def entries(ids: np.ndarray, **parts: np.ndarray):
    """A batch of ENTRY from stacks of matrices (or vectors, which are columns), one for each id."""
    import pyarrow as pa

    out = []
    for name, x in parts.items():
        x = x if x.ndim == 3 else x[:, :, None]
        k, i, j = np.indices(x.shape).reshape(3, -1)
        out.append((ids[k], np.full(len(k), name, object), i, j, x.ravel().astype(float)))
    columns = [np.concatenate(c) for c in zip(*out)]
    kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "part", "i", "j", "v"])


def stacks(batches, m: int, n: int):
    """ids and stacks of whole matrices from batches of (id, i, j, v) in the order of ids; no more than STACK elements, or a matrix, at once."""
    most = max(1, STACK // max(1, m * n))
    rest = [np.empty(0, np.int64)] * 3 + [np.empty(0)]

    def filled(columns):
        ids, at = np.unique(columns[0], return_inverse=True)
        for start in range(0, len(ids), most):
            own = (at >= start) & (at < start + most)
            x = np.zeros((min(most, len(ids) - start), m, n))
            np.add.at(x, (at[own] - start, columns[1][own], columns[2][own]), columns[3][own])
            yield ids[start : start + most], x

    for batch in batches:
        now = [np.concatenate([r, batch.column(k).to_numpy(zero_copy_only=False)]) for k, r in enumerate(rest)]
        whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        if whole >= STACK or whole and len(now[0]) >= most * 4:
            yield from filled([x[:whole] for x in now])
            now = [x[whole:] for x in now]
        rest = now
    if len(rest[0]):
        yield from filled(rest)


def by_id(df: DataFrame) -> DataFrame:
    own = df.select(F.col("id").cast("bigint").alias("id"), F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
    # by a hash of id, as rows that a join on id has dealt already wouldn't be dealt again, and adaptive execution may turn such a
    # join into a broadcast whose local reads split matrices
    return own.repartition(F.xxhash64("id")).sortWithinPartitions("id")


def per_matrix(df: DataFrame, m: int | DataFrame, n: int | None, f: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """f's parts for each matrix, as ENTRY, of m rows and n columns; matrices of different sizes come with a table (id, m, n).

    f takes stacks of matrices. Matrices of one size are dealt by id and factored many at once; of different sizes, one by one.
    """
    if isinstance(m, DataFrame):

        def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            own = f(dense(pdf, int(pdf["m"].iloc[0]), int(pdf["n"].iloc[0]))[None])
            return entries(np.array([key[0]], np.int64), **own).to_pandas()

        return df.join(m, "id").groupBy("id").applyInPandas(each, ENTRY)

    def run(batches):
        for ids, x in stacks(batches, m, n):
            yield entries(ids, **f(x))

    return by_id(df).mapInArrow(run, ENTRY)


def turned(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


def square(m: int | DataFrame, n: int | None) -> None:
    """Of sizes by id, a matrix that isn't square is an error in its task."""
    if not isinstance(m, DataFrame) and m != n:
        raise FactorizationError(f"{m} x {n} is not square")


def svd(df: DataFrame, m: int | DataFrame, n: int | None = None) -> DataFrame:
    """Parts u, s (descending) and vt of the thin decomposition."""
    return per_matrix(df, m, n, lambda a: dict(zip(("u", "s", "vt"), np.linalg.svd(a, full_matrices=False))))


def qr(df: DataFrame, m: int, n: int) -> DataFrame:
    return per_matrix(df, m, n, lambda a: dict(zip("qr", np.linalg.qr(a))))


def lq(df: DataFrame, m: int, n: int) -> DataFrame:
    def f(a: np.ndarray) -> dict[str, np.ndarray]:
        q, r = np.linalg.qr(turned(a))
        return {"l": turned(r), "q": turned(q)}

    return per_matrix(df, m, n, f)


def eigh(df: DataFrame, m: int, n: int) -> DataFrame:
    """Parts w (ascending) and v of symmetric matrices."""
    square(m, n)
    return per_matrix(df, m, n, lambda a: dict(zip("wv", np.linalg.eigh(a))))


def eigvals(df: DataFrame, m: int, n: int) -> DataFrame:
    """Parts re and im, in no order."""
    square(m, n)

    def f(a: np.ndarray) -> dict[str, np.ndarray]:
        w = np.linalg.eigvals(a)
        return {"re": w.real, "im": w.imag}

    return per_matrix(df, m, n, f)


def tridiagonal_eigh(df: DataFrame, n: int) -> DataFrame:
    """Of the symmetric tridiagonal matrices whose diagonal is in column 0 of the rows and whose subdiagonal is in column 1."""

    def f(a: np.ndarray) -> dict[str, np.ndarray]:
        x, k = np.zeros((len(a), n, n)), np.arange(n)
        x[:, k, k] = a[:, :, 0]
        x[:, k[1:], k[:-1]] = x[:, k[:-1], k[1:]] = a[:, 1:, 1]
        return dict(zip("wv", np.linalg.eigh(x)))

    return per_matrix(df, n, 2, f)


def solve(a: DataFrame, b: DataFrame, n: int, k: int) -> DataFrame:
    """Part x of a x = b for matrices with equal ids; b has k columns, which stand beside those of a where they are solved."""
    own = a.select("id", "i", "j", "v").unionByName(b.select("id", "i", (F.col("j") + n).alias("j"), "v"))
    both = own.join(a.select("id").distinct(), "id", "left_semi")
    return per_matrix(both, n, n + k, lambda x: {"x": np.linalg.solve(x[:, :, :n], x[:, :, n:])})


def inverse(df: DataFrame, m: int, n: int) -> DataFrame:
    square(m, n)
    return per_matrix(df, m, n, lambda a: {"x": np.linalg.inv(a)})


def exponential(a: np.ndarray) -> np.ndarray:
    """Scaling and squaring with the Padé approximant of order 13."""
    c = [64764752532480000, 32382376266240000, 7771770303897600, 1187353796428800, 129060195264000, 10559470521600, 670442572800, 33522128640, 1323241920, 40840800, 960960, 16380, 182, 1]
    size = np.abs(a).sum(axis=0).max(initial=0.0)
    times = max(0, int(np.ceil(np.log2(size / 5.371920351148152)))) if size else 0
    a = a / 2.0**times
    even = [np.eye(len(a))]
    for _ in range(6):
        even.append(even[-1] @ (a @ a))
    v = sum(x * p for x, p in zip(c[0::2], even))
    u = a @ sum(x * p for x, p in zip(c[1::2], even))
    out = np.linalg.solve(v - u, v + u)
    for _ in range(times):
        out = out @ out
    return out


def expm(df: DataFrame, m: int, n: int) -> DataFrame:
    square(m, n)
    return per_matrix(df, m, n, lambda a: {"x": np.stack([exponential(x) for x in a])})


def expm_symmetric(df: DataFrame, m: int, n: int) -> DataFrame:
    """Part x, the exponential of symmetric matrices by their eigenvalues."""
    square(m, n)

    def f(a: np.ndarray) -> dict[str, np.ndarray]:
        w, v = np.linalg.eigh(a)
        return {"x": v * np.exp(w)[:, None, :] @ turned(v)}

    return per_matrix(df, m, n, f)


def truncated(spectrum: DataFrame, chi_max: int | None = None, target: float | None = None, by: tuple[str, ...] = ("id",), kept_only: bool = False) -> DataFrame:
    """The spectrum (by, sector, s) with rank, discarded and kept: which values survive a truncation.

    Values are ranked across sectors, larger first and the smaller sector before. With a target, the smallest
    are dropped for as long as the norm of what is dropped is at most the target, and one stays; chi_max bounds
    how many stay. Squares are summed from the smallest up, in two levels, so that no task ranks a whole spectrum and small
    values aren't lost beside large ones. With kept_only, what a bound drops isn't returned and, without a target, is dropped
    part by part before any value is ranked.
    """
    if chi_max is not None and chi_max < 1:
        raise FactorizationError("chi_max must be at least 1")
    if chi_max is not None and target is None and kept_only:
        part = Window.partitionBy(*by, F.pmod(F.xxhash64("sector", "k"), F.lit(256))).orderBy(F.col("s").desc(), "sector", "k")
        spectrum = spectrum.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= chi_max).drop("rank")
    square = F.col("s").cast("double") * F.col("s").cast("double")
    order = [F.col("s").asc(), F.col("sector").desc(), F.col("k").desc()]
    summed = prefix_sums(spectrum, order, {"below": F.lit(1).cast("bigint"), "squares": square}, by=list(by), whole=True)
    out = summed.withColumn("rank", F.col("below_all") - F.col("below")).withColumn("discarded", F.sqrt(F.col("squares") + square)).select(*spectrum.columns, "rank", "discarded")
    kept = F.lit(True)
    if target is not None:
        kept = (F.col("discarded") > target) | (F.col("rank") == 1)
    if chi_max is not None:
        kept = kept & (F.col("rank") <= chi_max)
    out = out.withColumn("kept", kept)
    return out.where("kept").drop("discarded") if kept_only else out


def map_values(spectrum: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """A spectrum (sector, k, s) with f of every value."""
    return spectrum.withColumn("s", f(F.col("s")))


def product(df: DataFrame, left: str, right: str, diagonal: str | None = None) -> DataFrame:
    """The matrices left (times the diagonal) times right, from their parts, as id, i, j, v."""
    a = df.where(F.col("part") == left).select("id", "i", F.col("j").alias("k"), F.col("v").alias("x"))
    b = df.where(F.col("part") == right).select("id", F.col("i").alias("k"), "j", F.col("v").alias("y"))
    if diagonal:
        d = df.where(F.col("part") == diagonal).select("id", F.col("i").alias("k"), F.col("v").alias("d"))
        a = a.join(d, ["id", "k"]).select("id", "i", "k", (F.col("x") * F.col("d")).alias("x"))
    return a.join(b, ["id", "k"]).groupBy("id", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
