"""A dense tensor as a DataFrame: coordinates i0, i1, ... and a value v; a rank-0 tensor has one row.

Shapes are part of the tensor and never read from the data; explicit zeros may be stored, absent rows are zero.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import TensorError


def axes(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


def flat_index(shape: tuple[int, ...], order: str = "C", names: list[str] | None = None) -> Column:
    """The place of the coordinates in a flat buffer; C has the last axis fastest, F the first."""
    names, at = names or axes(len(shape)), F.lit(0).cast("bigint")
    for n, name in zip(shape, names) if order == "C" else zip(shape[::-1], names[::-1]):
        at = at * n + F.col(name)
    return at


def unflatten(at: Column, shape: tuple[int, ...], order: str = "C") -> list[Column]:
    out, step = [], 1
    for n in shape[::-1] if order == "C" else shape:
        out.append((F.floor(at / step) % n).cast("bigint"))
        step *= n
    out = out[::-1] if order == "C" else out
    return [c.alias(name) for c, name in zip(out, axes(len(shape)))]


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    shape: tuple[int, ...]

    def __post_init__(self) -> None:
        if any(isinstance(n, bool) or n < 0 for n in self.shape):
            raise TensorError(f"no shape {self.shape}")
        if set(self.df.columns) != {*self.axes, "v"} or len(self.df.columns) != self.rank + 1:
            raise TensorError(f"columns {self.df.columns} don't fit the shape {self.shape}")

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def axes(self) -> list[str]:
        return axes(self.rank)

    def with_values(self, v: Column) -> Tensor:
        return Tensor(self.df.select(*self.axes, v.alias("v")), self.shape)

    def complete(self) -> Tensor:
        """Every coordinate has a row."""
        grid = filled(self.df.sparkSession, self.shape, 0.0).df.select(*self.axes)
        df = grid.join(self.df, self.axes, "left").select(*self.axes, F.coalesce("v", F.lit(0)).alias("v")) if self.rank else grid.crossJoin(self.df.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v")))
        return Tensor(df, self.shape)


def filled(spark: SparkSession, shape: tuple[int, ...], value: float) -> Tensor:
    return Tensor(spark.range(prod(shape)).select(*unflatten(F.col("id"), shape), F.lit(value).alias("v")), shape)


def zeros(spark: SparkSession, shape: tuple[int, ...]) -> Tensor:
    return filled(spark, shape, 0.0)


def ones(spark: SparkSession, shape: tuple[int, ...]) -> Tensor:
    return filled(spark, shape, 1.0)


def eye(spark: SparkSession, n: int) -> Tensor:
    return Tensor(spark.range(n).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(1.0).alias("v")), (n, n))


def random(spark: SparkSession, shape: tuple[int, ...], seed: int) -> Tensor:
    """Uniform in [0, 1), the same for a seed at any partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11)
    return Tensor(spark.range(prod(shape)).select(*unflatten(F.col("id"), shape), (bits / float(1 << 53)).alias("v")), shape)


def from_values(spark: SparkSession, values: list[float], shape: tuple[int, ...]) -> Tensor:
    """A small tensor of a flat list in C order; of whole numbers as bigint, so that its products with others are exact, else of doubles."""
    if len(values) != prod(shape):
        raise TensorError(f"{len(values)} values don't fill the shape {shape}")
    kind = int if values and all(isinstance(v, int) and abs(v) < 1 << 63 for v in values) else float
    df = spark.createDataFrame([(i, kind(v)) for i, v in enumerate(values)], f"at bigint, v {'bigint' if kind is int else 'double'}")
    return Tensor(df.select(*unflatten(F.col("at"), shape), "v"), shape)


def from_table(df: DataFrame, coordinates: list[str], value: Column | str, shape: tuple[int, ...]) -> Tensor:
    """Sums of the value by coordinates."""
    summed = df.groupBy(*[F.col(c).cast("bigint").alias(a) for c, a in zip(coordinates, axes(len(coordinates)))]).agg(F.sum(value).alias("v"))
    return Tensor(summed, shape)
