"""Reshaping, slicing and joining of tensors: projections, filters and unions, without a shuffle where one isn't inherent."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TensorError
from ..tensor import Tensor, axes, flat_index, unflatten


def get(t: Tensor, at: tuple[int, ...]) -> float:
    bounded(t, at)
    row = t.df.where(is_at(t, at)).agg(F.sum("v")).first()
    return row[0] or 0.0


def set_value(t: Tensor, at: tuple[int, ...], value: float) -> Tensor:
    bounded(t, at)
    rest = t.df.where(~is_at(t, at))
    row = t.df.sparkSession.range(1).select(*(F.lit(x).cast("bigint").alias(a) for x, a in zip(at, t.axes)), F.lit(value).alias("v"))
    return Tensor(rest.unionByName(row), t.shape)


def is_at(t: Tensor, at: tuple[int, ...]) -> Column:
    out = F.lit(True)
    for a, x in zip(t.axes, at):
        out = out & (F.col(a) == x)
    return out


def bounded(t: Tensor, at: tuple[int, ...]) -> None:
    if len(at) != t.rank or any(not 0 <= x < n for x, n in zip(at, t.shape)):
        raise TensorError(f"{at} is outside the shape {t.shape}")


def slice_ranges(t: Tensor, ranges: list[tuple[int, int]]) -> Tensor:
    if len(ranges) != t.rank or any(not 0 <= a <= b <= n for (a, b), n in zip(ranges, t.shape)):
        raise TensorError(f"{ranges} is outside the shape {t.shape}")
    df = t.df
    for c, (a, b) in zip(t.axes, ranges):
        df = df.where((F.col(c) >= a) & (F.col(c) < b))
    return Tensor(df.select(*((F.col(c) - a).alias(c) for c, (a, _) in zip(t.axes, ranges)), "v"), tuple(b - a for a, b in ranges))


def expand(t: Tensor, pads: list[tuple[int, int]]) -> Tensor:
    """Zeros around the tensor; they aren't stored."""
    if len(pads) != t.rank or any(a < 0 or b < 0 for a, b in pads):
        raise TensorError(f"{pads} can't pad the shape {t.shape}")
    return Tensor(t.df.select(*((F.col(c) + a).alias(c) for c, (a, _) in zip(t.axes, pads)), "v"), tuple(a + n + b for n, (a, b) in zip(t.shape, pads)))


def replace_slice(t: Tensor, sub: Tensor, begin: tuple[int, ...]) -> Tensor:
    if len(begin) != t.rank or sub.rank != t.rank or any(b < 0 or b + m > n for b, m, n in zip(begin, sub.shape, t.shape)):
        raise TensorError(f"{sub.shape} at {begin} is outside the shape {t.shape}")
    inside = F.lit(True)
    for c, b, m in zip(t.axes, begin, sub.shape):
        inside = inside & (F.col(c) >= b) & (F.col(c) < b + m)
    moved = sub.df.select(*((F.col(c) + b).alias(c) for c, b in zip(t.axes, begin)), "v")
    return Tensor(t.df.where(~inside).unionByName(moved), t.shape)


def concatenate(parts: list[Tensor], axis: int) -> Tensor:
    first = parts[0]
    if any(p.rank != first.rank or any(k != axis and a != b for k, (a, b) in enumerate(zip(p.shape, first.shape))) for p in parts) or not 0 <= axis < first.rank:
        raise TensorError("shapes differ beside the axis")
    out, at = None, 0
    for p in parts:
        df = p.df.withColumn(f"i{axis}", F.col(f"i{axis}") + at)
        out, at = df if out is None else out.unionByName(df), at + p.shape[axis]
    return Tensor(out, (*first.shape[:axis], at, *first.shape[axis + 1 :]))


def stack(parts: list[Tensor], axis: int) -> Tensor:
    first = parts[0]
    if any(p.shape != first.shape for p in parts) or not 0 <= axis <= first.rank:
        raise TensorError("shapes differ")
    out = None
    for k, p in enumerate(parts):
        names = [c for c in p.axes]
        names.insert(axis, None)
        df = p.df.select(*((F.lit(k).cast("bigint") if c is None else F.col(c)).alias(a) for c, a in zip(names, axes(first.rank + 1))), "v")
        out = df if out is None else out.unionByName(df)
    return Tensor(out, (*first.shape[:axis], len(parts), *first.shape[axis:]))


def reshape(t: Tensor, shape: tuple[int, ...], order: str = "C") -> Tensor:
    """By the flat index in C order (logical) or F order (of a column-major buffer)."""
    if prod(shape) != prod(t.shape):
        raise TensorError(f"{t.shape} can't become {shape}")
    return Tensor(t.df.select(flat_index(t.shape, order).alias("at"), "v").select(*unflatten(F.col("at"), shape, order), "v"), tuple(shape))


def fuse_legs(t: Tensor, first: int, count: int) -> Tensor:
    if count < 1 or not 0 <= first <= t.rank - count:
        raise TensorError("no such legs")
    s = t.shape
    return reshape(t, (*s[:first], prod(s[first : first + count]), *s[first + count :]))


def split_leg(t: Tensor, axis: int, parts: tuple[int, ...]) -> Tensor:
    if not 0 <= axis < t.rank or prod(parts) != t.shape[axis]:
        raise TensorError(f"{parts} doesn't make the leg")
    return reshape(t, (*t.shape[:axis], *parts, *t.shape[axis + 1 :]))


def permute(t: Tensor, order: list[int]) -> Tensor:
    """Output axis k is input axis order[k]."""
    if sorted(order) != list(range(t.rank)):
        raise TensorError(f"{order} is no permutation of {t.rank} axes")
    return Tensor(t.df.select(*(F.col(f"i{k}").alias(a) for k, a in zip(order, t.axes)), "v"), tuple(t.shape[k] for k in order))


def diag(t: Tensor) -> Tensor:
    """The diagonal of a square matrix, or the diagonal matrix of a vector."""
    if t.rank == 1:
        return Tensor(t.df.select("i0", F.col("i0").alias("i1"), "v"), (t.shape[0],) * 2)
    if t.rank != 2 or t.shape[0] != t.shape[1]:
        raise TensorError("diag takes a vector or a square matrix")
    return Tensor(t.df.where("i0 = i1").select("i0", "v"), t.shape[:1])
