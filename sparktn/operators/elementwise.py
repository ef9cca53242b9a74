"""Functions of elements: projections, and unions with a sum where tensors are combined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TensorError
from ..tensor import Tensor, flat_index
from .contract import norm


def map_values(t: Tensor, f: Callable[[Column], Column]) -> Tensor:
    """Of the stored elements; a function that doesn't keep zero needs a complete tensor."""
    return t.with_values(f(F.col("v")))


def map_with_index(t: Tensor, f: Callable[..., Column]) -> Tensor:
    return t.with_values(f(*(F.col(a) for a in t.axes), F.col("v")))


def fill(t: Tensor, value: float) -> Tensor:
    return t.complete().with_values(F.lit(value))


def scale(t: Tensor, factor: float) -> Tensor:
    return t.with_values(F.col("v") * factor)


def linear_combine(parts: list[Tensor], coefficients: list[float]) -> Tensor:
    if not parts or len(parts) != len(coefficients) or any(p.shape != parts[0].shape for p in parts):
        raise TensorError("a combination takes tensors of one shape, each with a coefficient")
    out = None
    for p, c in zip(parts, coefficients):
        df = p.df.select(*p.axes, (F.col("v") * c).alias("v"))
        out = df if out is None else out.unionByName(df)
    return Tensor(out.groupBy(*parts[0].axes).agg(F.sum("v").alias("v")), parts[0].shape)


def add_all(parts: list[Tensor]) -> Tensor:
    """The sum; of whole numbers it is one, exact beyond 2^53."""
    return linear_combine(parts, [1] * len(parts))


def diagonal_scale(t: Tensor, axis: int, weights: Tensor) -> Tensor:
    """Multiplies each slice along the axis by its weight; both are dealt by the axis where they are large."""
    if weights.rank != 1 or not 0 <= axis < t.rank or weights.shape[0] != t.shape[axis]:
        raise TensorError("the weights don't fit the axis")
    w = weights.df.select(F.col("i0").alias(f"i{axis}"), F.col("v").alias("w"))
    return Tensor(t.df.join(w, f"i{axis}").select(*t.axes, (F.col("v") * F.col("w")).alias("v")), t.shape)


def normalized(t: Tensor) -> tuple[Tensor, float]:
    """Divided by the norm, element by element, and the norm it had; a zero tensor is an error."""
    n = norm(t)
    if n == 0:
        raise TensorError("a zero tensor has no direction")
    return t.with_values(F.col("v") / F.lit(n)), n


def normalize(t: Tensor) -> Tensor:
    return normalized(t)[0]


def flat_order(t: Tensor, order: str = "C") -> Tensor:
    """The vector of the elements in the order of a flat buffer."""
    n = 1
    for x in t.shape:
        n *= x
    return Tensor(t.df.select(flat_index(t.shape, order).alias("i0"), "v"), (n,))
