"""Sums over all rows before a row, in two levels: no window holds more than one part of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None, parts: int | None = None, whole: bool = False) -> DataFrame:
    """df with, under each name, the sum of its column over the rows before in the order, of the same `by` if given.

    Rows are dealt by ranges of `by` and the order and written once; every part sums its own rows, and the parts' sums
    (a row for each part, and value of `by` in it) are added up beside them. A group may span any number of parts.
    With whole, every name has a second column name_all, the sum over all rows. The order should be unique, as equal rows are of one part and come in any order; its nulls stand where the order puts
    them, and a null counts as 0 in a sum. An empty table stays empty.
    """
    by = by or []
    spark = df.sparkSession
    taken = {c.lower() for c in df.columns} | {name.lower() for name in sums}
    part = "part"
    while part.lower() in taken:
        part += "_"
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in by] + order
    own = df.withColumns({name: F.coalesce(c, F.lit(0)) for name, c in sums.items()})
    own = stored(own.repartitionByRange(n, *keys).withColumn(part, F.spark_partition_id()), "ranges")
    local = Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(part, *by).agg(*(F.sum(name).alias(name) for name in sums))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    names = [f"{part}_{k}" for k in range(len(sums))]
    bases = totals.select(F.col(part).alias(f"{part}_id"), *(F.col(c).alias(f"{part}_by_{k}") for k, c in enumerate(by)), *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(b) for name, b in zip(sums, names)), *(F.sum(name).over(Window.partitionBy(*by)).alias(f"{name}_all") for name in sums if whole))
    same = F.col(part) == F.col(f"{part}_id")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"{part}_by_{k}"))
    within = own.withColumns({name: F.coalesce(F.sum(name).over(local), F.lit(0)) for name in sums})
    joined = within.join(bases, same)
    return joined.select(*(F.col(c) for c in df.columns if c not in sums), *((F.col(name) + F.col(b)).alias(name) for name, b in zip(sums, names)), *(f"{name}_all" for name in sums if whole))
