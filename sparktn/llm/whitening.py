"""Embedding whitening by spectrum slicing.

The covariance of all vectors is summed up in Spark from whole numbers, so it is exact and the same on every run. Its leading
eigenvalues are found on the driver (the matrix has as many rows as a vector has entries, whatever the table's size):
the signs of D in the LDLt of the covariance less a shift count the eigenvalues above the shift, bisection by such counts
isolates each leading one, Rayleigh quotient iteration then converges cubically, and counts on both sides of what was found
certify its number. Vectors are whitened in the tasks that read them.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + OFFSET, held within LIMIT (entries of 10^10 and more).
SCALE, OFFSET, LIMIT = 64, 1_000_000, 1 << 40
COMPONENTS = 32
#: Whole numbers below this are squared and summed in doubles without loss, 1,024 rows at a time.
EXACT = 1 << 21
ROWS = 1024


def whole(values: np.ndarray) -> np.ndarray:
    """The whole numbers x of entries."""
    return np.clip(np.floor(SCALE * values) + OFFSET, -LIMIT, LIMIT).astype(np.int64)


def finite(df: DataFrame, key: str, column: str) -> DataFrame:
    """key and vec of the rows whose vector is not null and holds no null, NaN or infinity, as doubles."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.col(column).isNotNull() & ~bad).select(F.col(key).alias("key"), F.transform(column, lambda c: c.cast("double")).alias("vec"))


def dimension(rows: DataFrame) -> int:
    """The most frequent length of the vectors, of equals the greatest; 0 without vectors."""
    got = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return got["d"] if got else 0


def entries(batch, d: int, at: int = 0) -> np.ndarray:
    return np.asarray(batch.column(at).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are and the sum of each entry's x, exact."""

    def run(batches):
        import pyarrow as pa

        n, total = 0, [0] * d
        for batch in batches:
            x = whole(entries(batch, d))
            n += len(x)
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0))]
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([Decimal(n), *map(Decimal, total)], kind)], ["i", "s"])

    got = {r["i"]: int(r["s"]) for r in rows.select("vec").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return got.get(0, 0), [got.get(k + 1, 0) for k in range(d)]


def products(y: np.ndarray) -> np.ndarray:
    """The sum of the rows' products with themselves, of whole numbers, exact: as Python's numbers where doubles would round."""
    total: np.ndarray | None = None
    for part in np.split(y, range(ROWS, len(y), ROWS)):
        if np.abs(part).max(initial=0) < EXACT:
            own = np.rint(part.astype(np.float64).T @ part.astype(np.float64)).astype(np.int64).astype(object)
        else:
            low = (part & (EXACT - 1)).astype(np.float64)
            high = (part >> 21).astype(np.float64)
            hh, hl, ll = ((a.T @ b).astype(np.int64).astype(object) for a, b in ((high, high), (high, low), (low, low)))
            own = hh * (1 << 42) + (hl + hl.T) * (1 << 21) + ll
        total = own if total is None else total + own
    return total


def covariance(rows: DataFrame, d: int, n: int, total: list[int]) -> np.ndarray:
    """The covariance (divisor n) of all x: products of what is left after the mean's whole part, summed exactly, less the mean's rest."""
    floor, rest = [s // n for s in total], [s % n for s in total]
    centre = np.array(floor, np.int64)
    upper = np.triu_indices(d)

    def run(batches):
        import pyarrow as pa

        own: np.ndarray | None = None
        for batch in batches:
            if batch.num_rows:
                p = products(whole(entries(batch, d)) - centre)
                own = p if own is None else own + p
        if own is not None:
            ij = pa.array(np.arange(len(upper[0])), pa.int32())
            yield pa.RecordBatch.from_arrays([ij, pa.array(list(map(Decimal, own[upper].tolist())), pa.decimal128(38, 0))], ["ij", "p"])

    v = np.zeros((d, d))
    for r in rows.select("vec").mapInArrow(run, "ij int, p decimal(38,0)").groupBy("ij").agg(F.sum("p").alias("p")).collect():  # d (d + 1) / 2 numbers
        i, j = int(upper[0][r["ij"]]), int(upper[1][r["ij"]])
        v[i, j] = v[j, i] = float(Fraction(n * int(r["p"]) - rest[i] * rest[j], n * n))
    return v


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix are above the shift: positive ones of D in the LDLt of a - shift, with Bunch and Kaufman's pivots."""
    m = a - shift * np.eye(len(a))
    above, tiny = 0, np.finfo(float).tiny
    alpha = (1 + 17**0.5) / 8
    while len(m):
        column = np.abs(m[1:, 0])
        most = column.max(initial=0.0)
        one, swap = True, 0
        if most > 0 and abs(m[0, 0]) < alpha * most:
            r = 1 + int(column.argmax())
            row = np.abs(m[r]).copy()
            row[r] = 0
            if abs(m[0, 0]) * row.max() >= alpha * most**2:
                pass
            elif abs(m[r, r]) >= alpha * row.max():
                swap = r
            else:
                one = False
                if r != 1:
                    m[[1, r]] = m[[r, 1]]
                    m[:, [1, r]] = m[:, [r, 1]]
        if one:
            if swap:
                m[[0, swap]] = m[[swap, 0]]
                m[:, [0, swap]] = m[:, [swap, 0]]
            pivot = m[0, 0]
            if abs(pivot) < tiny:  # the shift is an eigenvalue of what is left, and counts as not above
                m = m[1:, 1:]
                continue
            above += pivot > 0
            m = m[1:, 1:] - np.outer(m[1:, 0], m[0, 1:]) / pivot
        else:
            above += 1  # such a pair of rows has one eigenvalue of each sign
            m = m[2:, 2:] - m[2:, :2] @ np.linalg.solve(m[:2, :2], m[:2, 2:])
        m = (m + m.T) / 2
    return above


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns, of those above rounding."""
    d = len(v)
    radius = np.abs(v).sum(axis=1).max(initial=0.0)
    if not radius > 0:
        return np.zeros(0), np.zeros((d, 0))
    floor = d * np.finfo(float).eps * radius
    close = 4 * floor
    k = min(most, inertia(v, floor))
    values, vectors = [], np.zeros((d, 0))
    known: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in known:
            known[shift] = inertia(v, shift)
        return known[shift]

    def polished(low: float, high: float, start: np.ndarray) -> tuple[float, np.ndarray]:
        """One pair from within the interval: inverse iteration at its middle, then Rayleigh quotients, beside the vectors found."""
        x, rho = start, (low + high) / 2
        for step in range(60):
            x = x - vectors @ (vectors.T @ x)
            x /= np.linalg.norm(x)
            quotient = float(x @ v @ x)
            residual = np.linalg.norm(v @ x - quotient * x)
            if residual <= close and low - floor / 2 <= quotient <= high + floor / 2:
                return quotient, x
            if step >= 3 and low <= quotient <= high:
                rho = quotient
            try:
                y = np.linalg.solve(v - rho * np.eye(d), x)
            except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
                y = np.linalg.solve(v - (rho + close / 8) * np.eye(d), x)
            x = y
        return float("nan"), x

    rng = np.random.default_rng(0)
    low, high = floor, radius * (1 + 1e-12) + floor
    while len(values) < k:
        number = len(values)
        # an interval (low, high] that holds the eigenvalue of this number and, unless it is as narrow as rounding, no other
        low, high = floor, min([radius * (1 + 1e-12) + floor, *([values[-1] + close] if values else [])])
        for shift, count in known.items():
            if count > number:
                low = max(low, shift)
            elif count <= number:
                high = min(high, shift) if shift > low else high
        while above(low) - above(high) > 1 and high - low > close or above(low) <= number:
            middle = (low + high) / 2
            if above(middle) > number:
                low = middle
            else:
                high = middle
        value, x = polished(low, high, rng.normal(size=d))
        while not np.isfinite(value) and high - low > close:  # narrower until the middle is nearest to it
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) > number else (low, middle)
            value, x = polished(low, high, rng.normal(size=d))
        if not np.isfinite(value):
            value = float(x @ v @ x)
        x = x - vectors @ (vectors.T @ x)
        vectors = np.column_stack([vectors, x / np.linalg.norm(x)])
        values.append(value)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[:, order]


def certified(v: np.ndarray, values: np.ndarray) -> bool:
    """Whether as many eigenvalues as each number says are above a shift just below it, and fewer than it above one just over it."""
    off = 16 * len(v) * np.finfo(float).eps * np.abs(v).sum(axis=1).max(initial=0.0)
    return all(inertia(v, e - off) >= k + 1 and inertia(v, e + off) <= k for k, e in enumerate(values))


def whitened(df: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained and identity_error.

    Vectors that are null or hold nulls, NaN or infinities are dropped, and so are those of another length than the most
    frequent one (of equals the greatest). Components whose eigenvalue is rounding of zero are left out, so equal vectors, or a
    single one, give no rows, as no vectors do. Repeated keys and null keys are rows like others. Entries are held within
    10^10, and a deviation beyond a long is null. Vectors may have thousands of entries: the driver holds a matrix of that
    size. Other columns aren't read.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    names = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = finite(df, key, column)
    d = dimension(rows)
    rows = rows.where(F.size("vec") == d)
    n, total = sums(rows, d) if d else (0, [])
    v = covariance(rows, d, n, total) if n else np.zeros((0, 0))
    values, vectors = leading(v, components) if n else (np.zeros(0), v)
    if not len(values):
        return spark.createDataFrame([], f"{key} {kind}, {names}")
    if not certified(v, values):
        raise ArithmeticError("the counts don't confirm the eigenvalues found")
    k = len(values)
    basis = vectors / np.sqrt(values)
    floor, rest = np.array([s // n for s in total], np.int64), np.array([s % n for s in total], np.int64)
    explained = values / np.trace(v)

    def projected(batch, at: int) -> tuple[np.ndarray, np.ndarray]:
        left = whole(entries(batch, d, at)) - floor
        return left, (left - rest / n) @ basis

    def squares(batches):
        import pyarrow as pa

        own = np.zeros((k, k))
        for batch in batches:
            w = projected(batch, 0)[1]
            own += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(own.ravel())], ["i", "j", "p"])

    identity = np.zeros((k, k))
    for r in rows.select("vec").mapInArrow(squares, "i bigint, j bigint, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect():  # 32 x 32 numbers
        identity[r["i"], r["j"]] = r["p"] / n
    error = float(np.abs(identity - np.eye(k)).max())

    def run(batches):
        import pyarrow as pa

        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):  # as many rows come out as there are components
                batch = whole_batch.slice(at, ROWS)
                left, w = projected(batch, 1)
                m = len(w)
                sizes = ((n * left.astype(np.float64) - rest) ** 2).sum(axis=1)
                fits = sizes < 9.2e18
                off = n * np.where(fits[:, None], left, 0) - rest
                deviation = np.where(fits, (off * off).sum(axis=1), 0)
                keys = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                        pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k)), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("key", "vec").mapInArrow(run, f"{key} {kind}, {names}")
