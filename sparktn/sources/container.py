"""Containers: one folder for a tensor, a complex or block tensor, or a table of chains, with a manifest that says what it holds.

Elements are written as they are typed, the manifest after them, so a folder half written has none and isn't a container.
Reading checks the manifest field by field before any element, and the elements against it as they are read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BlockError, ContainerError
from ..functions import sectors
from ..operators.blocks import BlockTensor, Leg, checked_blocks
from ..operators.complexes import ComplexTensor
from ..tensor import Tensor, axes

MAGIC, VERSION = "sparktn", 1
REAL = ("double", "float", "bigint", "int")


@dataclass(frozen=True)
class Chains:
    """A table of chains of n sites; bonds, if given, are the widths from edge to edge that no element is beyond."""

    df: DataFrame
    n: int
    kind: str = "state"
    bonds: tuple[int, ...] | None = None

    @property
    def coords(self) -> list[str]:
        return ["chain", "site", "l", *(["p"] if self.kind == "state" else ["ket", "bra"]), "r"]


Stored = Tensor | ComplexTensor | BlockTensor | Chains


def listed(q):
    """Pairs as lists of two, as JSON has them."""
    return [listed(x) for x in q] if isinstance(q, tuple) else q


def paired(q):
    return tuple(paired(x) for x in q) if isinstance(q, list) else q


def coords_of(x: Stored) -> list[str]:
    return x.coords if isinstance(x, BlockTensor | Chains) else x.axes


def values_of(df: DataFrame) -> tuple[list[str], str]:
    """The value columns and the type of an element."""
    values = [c for c in df.columns if c in ("v", "re", "im")]
    kinds = {df.schema[c].dataType.simpleString() for c in values}
    if values not in (["v"], ["re", "im"]) or len(kinds) != 1 or not kinds <= set(REAL):
        raise ContainerError(f"values {values} of types {sorted(kinds)}")
    return values, ("complex " if len(values) == 2 else "") + kinds.pop()


def save(x: Stored, path: str) -> None:
    """Writes a new folder; one that exists is an error, as what it holds might be read just now."""
    values, element = values_of(x.df)
    about: dict = {"magic": MAGIC, "version": VERSION, "element": element}
    if isinstance(x, BlockTensor):
        legs = [{"direction": leg.direction, "sectors": [listed(q) for q in leg.sectors], "dims": list(leg.dims)} for leg in x.legs]
        about |= {"kind": "blocks", "legs": legs, "flux": listed(x.flux), "sector": listed(x.kind)}
    elif isinstance(x, Chains):
        about |= {"kind": f"chains of {x.kind}s", "sites": x.n, "bonds": list(x.bonds) if x.bonds else None}
    else:
        about |= {"kind": "complex" if isinstance(x, ComplexTensor) else "dense", "shape": [int(n) for n in x.shape]}
    x.df.select(*coords_of(x), *values).write.parquet(f"{path}/elements")
    x.df.sparkSession.createDataFrame([(json.dumps(about),)], "manifest string").coalesce(1).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> dict:
    """The checked manifest of a container."""
    try:
        rows = spark.read.parquet(f"{path}/manifest").collect()  # a row
    except AnalysisException as e:
        raise ContainerError(f"{path} has no manifest") from e
    try:
        about = json.loads(rows[0]["manifest"])
    except (IndexError, KeyError, ValueError, TypeError) as e:
        raise ContainerError("the manifest can't be read") from e
    if len(rows) != 1 or not isinstance(about, dict) or about.get("magic") != MAGIC:
        raise ContainerError("not a container of this library")
    if about.get("version") != VERSION:
        raise ContainerError(f"version {about.get('version')} isn't known")
    base = str(about.get("element")).removeprefix("complex ")
    if base not in REAL:
        raise ContainerError(f"no elements of type {about.get('element')}")
    return about


def whole(x, least: int, what: str) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < least:
        raise ContainerError(f"{what} {x}")
    return x


def whole_list(x, least: int, what: str) -> tuple[int, ...]:
    if not isinstance(x, list):
        raise ContainerError(f"{what} {x}")
    return tuple(whole(n, least, what) for n in x)


def checked(df: DataFrame, coords: list[str], values: list[str], inside: Column) -> DataFrame:
    """Rows that are errors where they lie outside, repeat coordinates or have a null."""
    kind = df.schema[values[0]].dataType
    none = F.lit(False)
    for c in (*coords, *values):
        none = none | F.col(c).isNull()
    first = F.col(values[0])
    first = F.when(none, F.raise_error(F.lit("an element has a null")).cast(kind)).when(~inside, F.raise_error(F.lit("an element is outside")).cast(kind)).otherwise(first)
    rows = df.select(*coords, first.alias(values[0]), *values[1:])
    once = rows.groupBy(*coords).agg(*(F.min(v).alias(v) for v in values), F.count("*").alias("times"))
    single = F.when(F.col("times") == 1, F.col(values[0])).otherwise(F.raise_error(F.lit("coordinates are repeated")).cast(kind))
    return once.select(*coords, single.alias(values[0]), *values[1:])


def load(spark: SparkSession, path: str) -> Stored:
    """The object that the folder holds; a manifest that is wrong is an error at once, elements that are wrong when they are read."""
    about = manifest(spark, path)
    df = spark.read.parquet(f"{path}/elements")
    values = ["re", "im"] if about["element"].startswith("complex ") else ["v"]
    if not set(values) <= set(df.columns) or values_of(df)[1] != about["element"]:
        raise ContainerError(f"elements aren't {about['element']}")
    kind = about.get("kind")

    def fits(coords: list[str]) -> None:
        if df.columns != [*coords, *values]:
            raise ContainerError(f"columns {df.columns} aren't those of {kind}")

    inside = F.lit(True)
    if kind in ("dense", "complex"):
        shape = whole_list(about.get("shape"), 0, "an extent of")
        if (kind == "complex") != (values == ["re", "im"]):
            raise ContainerError(f"elements of a {kind} tensor aren't {about['element']}")
        fits(axes(len(shape)))
        for a, n in zip(axes(len(shape)), shape):
            inside = inside & (F.col(a) >= 0) & (F.col(a) < n)
        rows = checked(df, axes(len(shape)), values, inside)
        return ComplexTensor(rows, shape) if kind == "complex" else Tensor(rows, shape)
    if kind in ("chains of states", "chains of operators"):
        out = Chains(df, whole(about.get("sites"), 1, "sites"), kind.removeprefix("chains of ").removesuffix("s"))
        bonds = about.get("bonds")
        bonds = whole_list(bonds, 1, "a bond of") if bonds is not None else None
        if bonds and len(bonds) != out.n + 1:
            raise ContainerError(f"{len(bonds)} bonds of {out.n} sites")
        fits(out.coords)
        inside = F.col("site").between(0, out.n - 1)
        for c in out.coords[2:]:
            inside = inside & (F.col(c) >= 0)
        if bonds:
            width = lambda k: F.element_at(F.lit(list(bonds)), k.cast("int"))
            inside = inside & F.when(F.col("site").between(0, out.n - 1), (F.col("l") < width(F.col("site") + 1)) & (F.col("r") < width(F.col("site") + 2))).otherwise(False)
        return Chains(checked(df, out.coords, values, inside), out.n, out.kind, bonds)
    if kind == "blocks":
        try:
            sector = sectors.known(paired(about.get("sector")))
            legs = []
            for leg in about["legs"]:
                if leg["direction"] not in (1, -1):
                    raise ContainerError(f"a direction of {leg['direction']}")
                own = tuple(sectors.valid(sector, paired(q)) for q in leg["sectors"])
                dims = whole_list(leg["dims"], 1, "a size of")
                if list(own) != sorted(set(own)) or len(own) != len(dims):
                    raise ContainerError("sectors ascend without repeats, each with a size")
                legs.append(Leg(leg["direction"], own, dims))
            flux = sectors.valid(sector, paired(about["flux"]))
        except (KeyError, TypeError, BlockError) as e:
            raise ContainerError(f"legs, flux or sectors: {e}") from e
        fits([f"{c}{k}" for c in "bi" for k in range(len(legs))])
        rows = checked(df, df.columns[: -len(values)], values, inside)
        return checked_blocks(BlockTensor(rows, tuple(legs), flux, sector))
    raise ContainerError(f"no container holds {kind}")
