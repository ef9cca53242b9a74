"""SVD of a large sparse matrix (i, j, v) by a random sketch: neither its rows nor its columns need fit a task.

The random matrix is never stored: its element at (j, c) is a Gaussian number made from a hash. The sparse matrix is dealt
once; its parts meet the rows of a sketch and hand on sums. Orthonormal bases come from trees of small factors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FactorizationError
from ..sources.storage import bucketed, stored
from .contract import vectors
from .tall import orthonormal, tall_svd, times

#: Elements that a part has at most: a task holds them and the rows that they meet.
PART = 1 << 22
#: Fewer aren't dealt to more tasks.
LEAST = 1 << 18


def uniform(*parts: Column | int) -> Column:
    """Above 0 and at most 1."""
    bits = F.shiftrightunsigned(F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts)), 11)
    return (bits + 1) / float(1 << 53)


def gaussian(seed: int, at: Column, c: int) -> Column:
    """A number of the normal distribution for each place and column, the same on every run."""
    return F.sqrt(-2.0 * F.log(uniform(seed, 2 * c, at))) * F.cos(2 * math.pi * uniform(seed, 2 * c + 1, at))


def dealt(a: DataFrame) -> tuple[DataFrame, str]:
    """part, i, j and v in buckets of parts, and the table's name. Parts hold as many elements each and are ranges by j, then i,
    so that only a column at the end of a part has elements in others, however many a column has."""
    count = a.count()
    if not count:
        raise FactorizationError("a matrix of zeros has no values")
    least = min(2 * a.sparkSession.sparkContext.defaultParallelism, -(-count // LEAST))
    n = max(-(-count // PART), least)
    return bucketed(a.repartitionByRange(n, "j", "i").withColumn("part", F.spark_partition_id()), "dealt", "part", n, ["j", "i"])


def multiplied(a: DataFrame, x: DataFrame, n: int, along: str, to: str) -> DataFrame:
    """part, k, x and whether other parts may have sums for k: every part's elements times the rows (part, k, x) that it meets.

    The elements stay where they are. A part gets a row once, whatever number of elements meet it, and adds up its sums.
    """

    def run(key, left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = np.ascontiguousarray(vectors(right["x"].combine_chunks(), n).T)
        at = pc.index_in(left[along], value_set=right["k"].combine_chunks()).to_numpy()
        coded = left[to].combine_chunks().dictionary_encode("encode")
        keys, codes, v = coded.dictionary, coded.indices.to_numpy(), left["v"].to_numpy()
        sums = np.stack([np.bincount(codes, v * row[at], len(keys)) for row in rows], axis=1)
        ends = pc.min_max(keys)
        inside = pc.and_(pc.not_equal(keys, ends["min"]), pc.not_equal(keys, ends["max"])) if to == "j" else pa.array([False] * len(keys))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * n), pa.array(sums.ravel()))
        return pa.table([pa.repeat(key[0], len(keys)), keys, lists, pc.invert(pc.fill_null(inside, False))], ["part", "k", "x", "shared"])

    kind = a.schema[to].dataType.simpleString()
    elements = a.select("part", along, to, "v").groupBy("part")
    return elements.cogroup(x.select("part", "k", "x").groupBy("part")).applyInArrow(run, f"part int, k {kind}, x array<double>, shared boolean")


def gathered(sums: DataFrame, n: int) -> DataFrame:
    """at (k and the parts that have elements there) and x, summed over the parts."""
    rows = sums.groupBy("k").agg(F.collect_set("part").alias("parts"), *(F.sum(F.col("x")[c]).alias(f"x{c}") for c in range(n)))
    return rows.select(F.struct("k", "parts").alias("at"), F.array(*(f"x{c}" for c in range(n))).alias("x"))


def projected(a: DataFrame, x: DataFrame, n: int, along: str, to: str) -> DataFrame:
    """at and x, stored: the dealt matrix (or its transpose) times the rows (part, k, x of n numbers)."""
    sums = multiplied(a, x, n, along, to)
    if to == "i":
        return stored(gathered(sums, n), "sketch")
    sums = stored(sums, "sketch", by="shared")
    alone = sums.where("not shared").select(F.struct("k", F.array("part").alias("parts")).alias("at"), "x")
    return alone.unionByName(gathered(sums.where("shared"), n))


def spread(x: DataFrame) -> DataFrame:
    """part, k and x: every row for each part that has elements there."""
    return x.select(F.explode("at.parts").alias("part"), "at.k", "x")


def sparse_svd(a: DataFrame, values: int, more: int = 8, powers: int = 2, seed: int = 0) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Left vectors (i, u array), the largest values and right vectors (j, w array) of a matrix of elements (i, j, v).

    `more` columns beyond the values asked for, and power steps, bring the sketch near the leading vectors; a matrix whose rank
    is at most values + more is factored to rounding. Rows and columns of zeros have no vectors. Repeated coordinates add
    up; a matrix without elements other than zero is an error.
    """
    if values < 1 or more < 0 or powers < 0:
        raise FactorizationError("a value at least, and no negative number of columns or steps")
    a = stored(a.groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v")).where("v <> 0"), "sparse")
    n = values + more
    a, table = dealt(a)

    def basis(x: DataFrame, n: int) -> tuple[DataFrame, int]:
        q, small, _ = orthonormal(x, "at", "x", n)
        return q.select("at", F.col("q").alias("x")), small[-1].shape[1]

    first = a.select("part", F.col("j").alias("k")).distinct().withColumn("x", F.array(*(gaussian(seed, F.col("k"), c) for c in range(n))))
    q, n = basis(projected(a, first, n, "j", "i"), n)
    for _ in range(powers):
        z, n = basis(projected(a, spread(q), n, "i", "j"), n)
        q, n = basis(projected(a, spread(z), n, "j", "i"), n)
    b = projected(a, spread(q), n, "i", "j")
    a.sparkSession.sql(f"drop table {table}")
    w, s, v = tall_svd(b, "at", "x", n)
    k = min(values, len(s))
    left = times(q, "at", "x", n, v[:, :k], name="u")
    return left.select(F.col("at.k").alias("i"), "u"), s[:k], w.select(F.col("at.k").alias("j"), F.slice("u", 1, k).alias("w"))
