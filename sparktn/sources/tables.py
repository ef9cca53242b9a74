"""Tensors from and to files: Parquet tables of elements with the shape beside them, and encodings of business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TensorError
from ..operators.blocks import BlockTensor, Leg, checked_blocks
from ..tensor import Tensor, axes
from .storage import shared_path, stored  # noqa: F401  also named here for callers of this module


def save(t: Tensor, path: str) -> None:
    """Elements under path/elements, then the shape under path/shape; without a shape there is no tensor."""
    t.df.select(*t.axes, F.col("v").cast("double").alias("v")).write.parquet(f"{path}/elements")
    t.df.sparkSession.createDataFrame([(list(map(int, t.shape)),)], "shape array<bigint>").write.parquet(f"{path}/shape")


def load(spark: SparkSession, path: str) -> Tensor:
    """Rejects elements outside the shape, repeated coordinates and a number of axes that doesn't fit; a tensor half saved isn't one."""
    shape = tuple(spark.read.parquet(f"{path}/shape").first()["shape"])
    df = spark.read.parquet(f"{path}/elements")
    if df.columns != [*axes(len(shape)), "v"]:
        raise TensorError(f"columns {df.columns} don't fit the shape {shape}")
    inside = F.lit(True)
    for a, n in zip(axes(len(shape)), shape):
        inside = inside & (F.col(a) >= 0) & (F.col(a) < n)
    checked = F.when(inside, F.col("v")).otherwise(F.raise_error(F.lit("an element is outside the shape")).cast("double"))
    once = df.select(*axes(len(shape)), checked.alias("v")).groupBy(*axes(len(shape))).agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    single = F.when(F.col("n") == 1, F.col("v")).otherwise(F.raise_error(F.lit("coordinates are repeated")).cast("double"))
    return Tensor(once.select(*axes(len(shape)), single.alias("v")), shape)


def save_blocks(t: BlockTensor, path: str) -> None:
    """Elements under path/elements, then legs with their sectors, the flux and the kind under path/legs."""
    t.df.select(*t.coords, F.col("v").cast("double").alias("v")).write.parquet(f"{path}/elements")
    rows = [(axis, leg.direction, list(leg.sectors), list(leg.dims), t.flux, t.kind) for axis, leg in enumerate(t.legs)]
    t.df.sparkSession.createDataFrame(rows, "axis int, direction int, sectors array<int>, dims array<int>, flux int, kind string").coalesce(1).write.parquet(f"{path}/legs")


def load_blocks(spark: SparkSession, path: str) -> BlockTensor:
    """Rejects elements of blocks that the flux forbids or outside their block, and columns that don't fit the legs."""
    rows = spark.read.parquet(f"{path}/legs").orderBy("axis").collect()  # a row for each leg
    legs = tuple(Leg(r["direction"], tuple(r["sectors"]), tuple(r["dims"])) for r in rows)
    t = BlockTensor(spark.read.parquet(f"{path}/elements"), legs, rows[0]["flux"], rows[0]["kind"])
    if t.df.columns != [*t.coords, "v"]:
        raise TensorError(f"columns {t.df.columns} don't fit {len(legs)} legs")
    return checked_blocks(t)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantities(spark: SparkSession, sf_dir: str, by: tuple[str, str]) -> DataFrame:
    """Sums of whole quantities, exact in any order."""
    rows = read(spark, sf_dir, "lineitem").select(*(F.col(c).cast("bigint").alias(f"i{k}") for k, c in enumerate(by)), F.col("l_quantity").cast("bigint").alias("v"))
    return rows.groupBy("i0", "i1").agg(F.sum("v").alias("v"))
