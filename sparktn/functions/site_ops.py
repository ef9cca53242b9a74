"""Operators of one site with two states, as tables (ket, bra, re, im) of their elements that aren't zero."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame, SparkSession

from ..errors import TensorError

#: The matrices of spin one half and of a qubit, row by row.
ROOT = 1 / sqrt(2)
OPERATORS: dict[str, dict[str, list[list[complex]]]] = {
    "spin_half": {
        "id": [[1, 0], [0, 1]],
        "sz": [[0.5, 0], [0, -0.5]],
        "sp": [[0, 1], [0, 0]],
        "sm": [[0, 0], [1, 0]],
    },
    "qubit": {
        "id": [[1, 0], [0, 1]],
        "x": [[0, 1], [1, 0]],
        "y": [[0, -1j], [1j, 0]],
        "z": [[1, 0], [0, -1]],
        "h": [[ROOT, ROOT], [ROOT, -ROOT]],
        "s": [[1, 0], [0, 1j]],
        "t": [[1, 0], [0, ROOT + 1j * ROOT]],
        "proj0": [[1, 0], [0, 0]],
        "proj1": [[0, 0], [0, 1]],
    },
}


def site_operator(spark: SparkSession, family: str, name: str) -> DataFrame:
    """Rows are bra, columns ket: the state `ket` goes to the sum of states `bra`."""
    try:
        m = OPERATORS[family][name]
    except KeyError:
        raise TensorError(f"no operator {name} of {family}") from None
    rows = [(ket, bra, complex(m[bra][ket]).real, complex(m[bra][ket]).imag) for bra in range(2) for ket in range(2) if m[bra][ket]]
    return spark.createDataFrame(rows, "ket bigint, bra bigint, re double, im double")


def applied(states: DataFrame, op: DataFrame) -> DataFrame:
    """The operator on every site of real or complex states (chain, site, l, p, r, re, im): one broadcast join of four rows at most."""
    from pyspark.sql import functions as F

    o = F.broadcast(op.select(F.col("ket").alias("p"), "bra", F.col("re").alias("x"), F.col("im").alias("y")))
    joined = states.join(o, "p")
    re, im = F.col("re") * F.col("x") - F.col("im") * F.col("y"), F.col("re") * F.col("y") + F.col("im") * F.col("x")
    return joined.groupBy("chain", "site", "l", F.col("bra").alias("p"), "r").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
