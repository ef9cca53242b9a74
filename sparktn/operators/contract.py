"""Contractions are equi-joins on shared indices and sums by the free ones; traces are filters and sums.

An expression of several operands is evaluated pair by pair, in the order whose joins make the fewest rows, and each
step sums what no later operand and not the output needs, which Catalyst doesn't do for joins under one aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ContractionError
from ..tensor import Tensor, axes


def labels_of(notation: str, tensors: list) -> tuple[list[str], str]:
    """The operands' labels and the output's; without an arrow, labels that occur once, sorted."""
    left, arrow, out = notation.replace(" ", "").partition("->")
    parts = left.split(",")
    used = "".join(parts)
    if not used.isascii() or not (used + out or "a").isalpha() and used + out:
        raise ContractionError("indices are letters")
    out = out if arrow else "".join(sorted(c for c in set(used) if used.count(c) == 1))
    if len(parts) != len(tensors) or any(len(p) != t.rank for p, t in zip(parts, tensors)):
        raise ContractionError(f"{notation} doesn't fit the operands")
    if len(set(out)) != len(out) or not set(out) <= set(used):
        raise ContractionError("the output repeats an index or has one that no operand has")
    sizes: dict[str, int] = {}
    for p, t in zip(parts, tensors):
        for c, n in zip(p, t.shape):
            if sizes.setdefault(c, n) != n:
                raise ContractionError(f"index {c} has sizes {sizes[c]} and {n}")
    return parts, out


def order_by_cost(parts: list[str], out: str, sizes: dict[str, int], rows: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Which two operands to contract, and under which number the result goes on, step by step.

    The cost of an order is the sum of the rows that its joins are estimated to make: the rows of both sides over the
    sizes of what they share; a result has no more rows than its indices have values. Without counts of rows, operands are
    full. All orders are compared, by subsets, of ten operands at most; of more, the cheapest pair comes next each time. Of
    equal orders the one that takes earlier operands first counts.
    """
    n = len(parts)
    size_of = lambda labels: math.prod(sizes[c] for c in labels)
    count = rows or [size_of(p) for p in parts]
    bits = [1 << k for k in range(n)]

    def labels(s: int) -> set[str]:
        """What a later operand or the output needs of the operands in s."""
        inside = set().union(*(parts[k] for k in range(n) if s & bits[k]))
        later = set(out).union(*(parts[k] for k in range(n) if not s & bits[k]))
        return inside & later if s & (s - 1) else inside

    def join(s: int, t: int, at: dict[int, float]) -> float:
        shared = labels(s) & labels(t)
        return max(1.0, at[s] * at[t] / size_of(shared))

    if n > 10:
        at, names, steps = {b: float(c) for b, c in zip(bits, count)}, dict(zip(bits, range(n))), []
        while len(names) > 1:
            s, t = min(((s, t) for s in names for t in names if s < t), key=lambda x: join(*x, at))
            at[s | t] = min(join(s, t, at), float(size_of(labels(s | t))))
            steps.append((names.pop(s), names.pop(t), n + len(steps)))
            names[s | t] = steps[-1][2]
        return steps
    best: dict[int, tuple[float, int]] = {b: (0.0, 0) for b in bits}
    at = {b: float(c) for b, c in zip(bits, count)}
    for s in range(1, 1 << n):
        if s in best:
            continue
        choices, sub, lowest = [], (s - 1) & s, s & -s
        while sub:
            if sub & lowest:  # each split once
                choices.append((best[sub][0] + best[s ^ sub][0] + join(sub, s ^ sub, at), -sub, sub))
            sub = (sub - 1) & s
        cost, _, left = min(choices)
        at[s] = min(join(left, s ^ left, at), float(size_of(labels(s))))
        best[s] = cost, left
    steps = []

    def walk(s: int) -> int:
        if not s & (s - 1):
            return s.bit_length() - 1
        left = best[s][1]
        a, b = walk(left), walk(s ^ left)
        steps.append((a, b, n + len(steps)))
        return steps[-1][2]

    walk((1 << n) - 1)
    return steps


def einsum(notation: str, *tensors: Tensor, rows: list[int] | None = None) -> Tensor:
    """Absent elements of the result are zero. One operand: traces and permutations; more: pairs, in the cheapest order.

    rows: how many elements each operand has, where that is known; without it operands count as full.
    """
    parts, out = labels_of(notation, list(tensors))
    sizes = {c: n for p, t in zip(parts, tensors) for c, n in zip(p, t.shape)}
    if len(parts) == 1:
        (p,) = parts
        if any(p.count(c) > 2 or (p.count(c) == 2) == (c in out) for c in set(p)):
            raise ContractionError("one operand is traced or permuted only")
        pairs = [tuple(i for i, x in enumerate(p) if x == c) for c in dict.fromkeys(p) if p.count(c) == 2]
        rest = [c for c in p if p.count(c) == 1]
        t = trace(tensors[0], pairs) if pairs else tensors[0]
        return Tensor(t.df.select(*(F.col(f"i{rest.index(c)}").alias(a) for c, a in zip(out, axes(len(out)))), "v"), tuple(sizes[c] for c in out))
    if any(len(set(p)) != len(p) for p in parts):
        raise ContractionError("an operand repeats an index")
    lone = [c for c in sizes if c not in out and sum(c in p for p in parts) < 2]
    if lone:
        raise ContractionError(f"index {lone[0]} is in one operand and not in the output")
    have = {k: (list(p), t.df.select(*(F.col(a).alias(f"x_{c}") for a, c in zip(t.axes, p)), "v")) for k, (p, t) in enumerate(zip(parts, tensors))}
    for a, b, to in order_by_cost(parts, out, sizes, rows):
        (p, left), (q, right) = have.pop(a), have.pop(b)
        later = set(out).union(*(r for r, _ in have.values()))
        shared = [c for c in p if c in q]
        keep = [c for c in dict.fromkeys([*p, *q]) if c in later]
        right = right.withColumnRenamed("v", "w")
        joined = left.join(right, [f"x_{c}" for c in shared]) if shared else left.crossJoin(right)
        product = F.col("v") * F.col("w")
        summed = joined.groupBy(*[f"x_{c}" for c in keep]).agg(F.sum(product).alias("v")) if set(keep) != {*p, *q} else joined.select(*[f"x_{c}" for c in keep], product.alias("v"))
        have[to] = keep, summed
    ((_, named),) = have.values()
    return Tensor(named.select(*(F.col(f"x_{c}").alias(a) for c, a in zip(out, axes(len(out)))), F.coalesce("v", F.lit(0)).alias("v")), tuple(sizes[c] for c in out))


def gram(rows: DataFrame, column: str, n: int) -> Tensor:
    """The products of n columns with each other, summed over rows that hold n numbers each as an array.

    Every batch is multiplied in its task and every task adds up its batches, so n x n sums leave a task, not n x n
    products a row. Sums of whole numbers are exact below 2^53. A row of another length or with a null is an error.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total = np.zeros((n, n))
        for batch in batches:
            x = vectors(batch.column(0), n)
            total += x.T @ x
        i, j = np.indices((n, n)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i0", "i1", "v"])

    parts = rows.select(whole_rows(column, n).alias("x")).mapInArrow(run, "i0 bigint, i1 bigint, v double")
    return Tensor(parts.groupBy("i0", "i1").agg(F.sum("v").alias("v")), (n, n))


def whole_rows(column: str, n: int):
    """The column's arrays as doubles; one that is null, has a null or another length than n is an error."""
    x = F.col(column)
    whole = x.isNotNull() & (F.size(x) == n) & ~F.exists(x, lambda v: v.isNull())
    return F.when(whole, x.cast("array<double>")).otherwise(F.raise_error(F.lit(f"a row of {column} isn't {n} numbers")).cast("array<double>"))


def vectors(column, n: int):
    """An Arrow column of arrays of n doubles as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def contract(a: Tensor, b: Tensor, notation: str) -> Tensor:
    """Two operands; an index in both is summed and can't be in the output."""
    (p, q), out = labels_of(notation, [a, b])
    if set(p) & set(q) & set(out) or len(set(p)) != len(p) or len(set(q)) != len(q) or (set(p) ^ set(q)) != set(out):
        raise ContractionError(f"{notation} isn't a plain contraction")
    return einsum(f"{p},{q}->{out}", a, b)


def tensordot(a: Tensor, b: Tensor, axes_a: list[int], axes_b: list[int]) -> Tensor:
    """Free axes of a, then those of b; without axes the outer product."""
    if len(axes_a) != len(axes_b) or len(set(axes_a)) != len(axes_a) or len(set(axes_b)) != len(axes_b):
        raise ContractionError("axes must pair up")
    names = iter("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    p = [next(names) for _ in a.shape]
    q = [p[axes_a[axes_b.index(k)]] if k in axes_b else next(names) for k in range(b.rank)]
    return einsum(f"{''.join(p)},{''.join(q)}->{''.join(c for c in p if c not in q)}{''.join(c for c in q if c not in p)}", a, b)


def trace(t: Tensor, pairs: list[tuple[int, int]]) -> Tensor:
    """Sums where paired axes are equal; a full trace has rank 0."""
    used = [k for p in pairs for k in p]
    if len(set(used)) != len(used) or any(not 0 <= k < t.rank for k in used) or any(t.shape[a] != t.shape[b] for a, b in pairs):
        raise ContractionError(f"{pairs} can't be traced")
    if not pairs:
        return t
    df = t.df
    for a, b in pairs:
        df = df.where(F.col(f"i{a}") == F.col(f"i{b}"))
    free = [k for k in range(t.rank) if k not in used]
    summed = df.groupBy(*(F.col(f"i{k}").alias(a) for k, a in zip(free, axes(len(free))))).agg(F.sum("v").alias("v"))
    return Tensor(summed.select(*axes(len(free)), F.coalesce("v", F.lit(0)).alias("v")), tuple(t.shape[k] for k in free))


def norm_parts(t: Tensor) -> DataFrame:
    """exponent and sumsq: sums of squares of the elements, each scaled by its binary exponent, a row for each exponent.

    One pass whose partial sums merge across partitions; no more rows than exponents of a double. NaN and
    infinity have exponents beyond all others.
    """
    v = F.abs(F.col("v").cast("double"))
    wild = F.isnan(v) | (v == float("inf"))
    e = F.when(F.isnan(v), 3000).when(v == float("inf"), 2000).otherwise(F.greatest(F.floor(F.log2(v)), F.lit(-1000)))
    half = F.floor(e / 2)  # two powers of two, as one may be out of range
    return t.df.where("v <> 0").select(e.cast("int").alias("exponent"), F.when(wild, 1.0).otherwise(F.pow(v * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - e), 2)).alias("q")).groupBy("exponent").agg(F.sum("q").alias("sumsq"))


def norm(t: Tensor) -> float:
    """The Frobenius norm without overflow. NaN wins over infinity; an empty tensor has norm 0."""
    parts = {r["exponent"]: r["sumsq"] for r in norm_parts(t).collect()}
    if 3000 in parts:
        return math.nan
    if 2000 in parts or not parts:
        return math.inf if parts else 0.0
    top = max(parts)
    root = math.sqrt(math.fsum(math.ldexp(q, max(2 * (e - top), -1074)) for e, q in parts.items()))
    return math.inf if math.log2(root) + top >= 1024 else math.ldexp(root, top)


def combine_norms(a: float, b: float) -> float:
    """The norm of two norms; NaN wins over infinity."""
    return math.nan if math.isnan(a) or math.isnan(b) else math.hypot(a, b)


def inner(a: Tensor, b: Tensor) -> DataFrame:
    return a.df.join(b.df.withColumnRenamed("v", "w"), a.axes).agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0)).alias("v"))
