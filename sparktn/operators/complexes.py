"""Tensors of complex numbers: coordinates with the columns re and im, so that every operation stays a column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ContractionError, TensorError
from ..tensor import Tensor, axes
from .contract import labels_of


@dataclass(frozen=True)
class ComplexTensor:
    df: DataFrame
    shape: tuple[int, ...]

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def axes(self) -> list[str]:
        return axes(self.rank)

    def with_parts(self, re: Column, im: Column) -> ComplexTensor:
        return ComplexTensor(self.df.select(*self.axes, re.alias("re"), im.alias("im")), self.shape)


def to_complex(t: Tensor, imaginary: Tensor | None = None) -> ComplexTensor:
    """t as the real part; with another tensor as the imaginary one, an element is stored if either has it."""
    if imaginary is None:
        return ComplexTensor(t.df.select(*t.axes, F.col("v").alias("re"), (F.col("v") * 0).alias("im")), t.shape)
    if t.shape != imaginary.shape:
        raise TensorError(f"parts of shapes {t.shape} and {imaginary.shape}")
    both = t.df.select(*t.axes, F.col("v").alias("re"), (F.col("v") * 0).alias("im")).unionByName(imaginary.df.select(*t.axes, (F.col("v") * 0).alias("re"), F.col("v").alias("im")))
    return ComplexTensor(both.groupBy(*t.axes).agg(F.sum("re").alias("re"), F.sum("im").alias("im")), t.shape)


def real(t: ComplexTensor) -> Tensor:
    return Tensor(t.df.select(*t.axes, F.col("re").alias("v")), t.shape)


def imag(t: ComplexTensor) -> Tensor:
    return Tensor(t.df.select(*t.axes, F.col("im").alias("v")), t.shape)


def magnitude(t: ComplexTensor) -> Tensor:
    return Tensor(t.df.select(*t.axes, F.hypot("re", "im").alias("v")), t.shape)


def conj(t: ComplexTensor) -> ComplexTensor:
    return t.with_parts(F.col("re"), -F.col("im"))


def conjugate_transpose(t: ComplexTensor, order: list[int] | None = None) -> ComplexTensor:
    """Conjugated, with the axes in this order, by default from last to first."""
    order = list(range(t.rank))[::-1] if order is None else order
    if sorted(order) != list(range(t.rank)):
        raise TensorError(f"{order} is no permutation of {t.rank} axes")
    df = t.df.select(*(F.col(f"i{k}").alias(a) for k, a in zip(order, t.axes)), "re", (-F.col("im")).alias("im"))
    return ComplexTensor(df, tuple(t.shape[k] for k in order))


def scale(t: ComplexTensor, re: float, im: float = 0) -> ComplexTensor:
    return t.with_parts(F.col("re") * re - F.col("im") * im, F.col("re") * im + F.col("im") * re)


def contract(a: ComplexTensor, b: ComplexTensor, notation: str) -> ComplexTensor:
    """Two operands, one join and one sum of both parts; an index in both is summed unless the output has it."""
    (p, q), out = labels_of(notation, [a, b])
    if len(set(p)) != len(p) or len(set(q)) != len(q) or not set(p) ^ set(q) <= set(out):
        raise ContractionError(f"{notation} isn't a contraction of two operands")
    left = a.df.select(*(F.col(x).alias(f"x_{c}") for x, c in zip(a.axes, p)), "re", "im")
    right = b.df.select(*(F.col(x).alias(f"x_{c}") for x, c in zip(b.axes, q)), F.col("re").alias("re2"), F.col("im").alias("im2"))
    shared = [f"x_{c}" for c in p if c in q]
    joined = left.join(right, shared) if shared else left.crossJoin(right)
    re, im = F.col("re") * F.col("re2") - F.col("im") * F.col("im2"), F.col("re") * F.col("im2") + F.col("im") * F.col("re2")
    summed = joined.groupBy(*(F.col(f"x_{c}").alias(x) for c, x in zip(out, axes(len(out))))).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    sizes = dict(zip(p + q, a.shape + b.shape))
    return ComplexTensor(summed.select(*axes(len(out)), F.coalesce("re", F.lit(0)).alias("re"), F.coalesce("im", F.lit(0)).alias("im")), tuple(sizes[c] for c in out))


def inner(a: ComplexTensor, b: ComplexTensor) -> DataFrame:
    """re and im of the product of a, conjugated, with b."""
    names = "abcdefghijklmnopqrstuvwxyz"[: a.rank]
    return contract(conj(a), b, f"{names},{names}->").df


def real_from(c: Column) -> Column:
    """The number as a double, or null where it isn't finite."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
