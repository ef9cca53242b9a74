"""Symmetry sectors as values and as column expressions: U1 charges add, Z2 charges take the exclusive or, pairs go part by part.

A kind is "u1", "z2" or a pair of kinds, which may be pairs again. A sector is a whole number or a pair like its kind, in
columns an int or a struct of a and b. U1 charges are 32-bit and Z2 ones 0 or 1; what is beyond is an error, also of a sum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BlockError

Kind = str | tuple
Sector = int | tuple
LOW, HIGH = -(1 << 31), (1 << 31) - 1


def known(kind: Kind) -> Kind:
    if isinstance(kind, tuple) and len(kind) == 2:
        return known(kind[0]), known(kind[1])
    if kind not in ("u1", "z2"):
        raise BlockError(f"no sector kind {kind}")
    return kind


def valid(kind: Kind, q: Sector) -> Sector:
    """The sector, or an error where it isn't one of the kind."""
    if isinstance(known(kind), tuple):
        if not isinstance(q, tuple) or len(q) != 2:
            raise BlockError(f"{q} is no pair")
        return valid(kind[0], q[0]), valid(kind[1], q[1])
    if isinstance(q, bool) or not isinstance(q, int) or not (q in (0, 1) if kind == "z2" else LOW <= q <= HIGH):
        raise BlockError(f"{q} is no sector of {kind}")
    return q


def identity(kind: Kind) -> Sector:
    return (identity(kind[0]), identity(kind[1])) if isinstance(known(kind), tuple) else 0


def fused(kind: Kind, a: Sector, b: Sector) -> Sector:
    a, b = valid(kind, a), valid(kind, b)
    if isinstance(kind, tuple):
        return fused(kind[0], a[0], b[0]), fused(kind[1], a[1], b[1])
    return valid(kind, a + b) if kind == "u1" else a ^ b


def dual_of(kind: Kind, q: Sector) -> Sector:
    q = valid(kind, q)
    if isinstance(kind, tuple):
        return dual_of(kind[0], q[0]), dual_of(kind[1], q[1])
    return valid(kind, -q) if kind == "u1" else q


def ddl(kind: Kind) -> str:
    return f"struct<a:{ddl(kind[0])},b:{ddl(kind[1])}>" if isinstance(known(kind), tuple) else "int"


def literal(kind: Kind, q: Sector) -> Column:
    if isinstance(kind, tuple):
        return F.struct(literal(kind[0], q[0]).alias("a"), literal(kind[1], q[1]).alias("b"))
    return F.lit(q).cast("int")


def at(kind: Kind, sectors: tuple[Sector, ...], number: Column) -> Column:
    """The sector of this number, from 0, in a list."""
    return F.element_at(F.array(*(literal(kind, q) for q in sectors)), (number + 1).cast("int"))


def value(row) -> Sector:
    """A collected sector as a number or pair."""
    return row if isinstance(row, int) else (value(row[0]), value(row[1]))


def fuse(kind: Kind, parts: list[Column]) -> Column:
    if isinstance(known(kind), tuple):
        return F.struct(*(fuse(k, [p[c] for p in parts]).alias(c) for k, c in zip(kind, "ab")))
    if kind == "z2":
        return reduce(lambda a, b: a.bitwiseXOR(b), parts, F.lit(0))
    return checked("u1", reduce(lambda a, b: a + b.cast("bigint"), parts, F.lit(0).cast("bigint"))).cast("int")


def dual(kind: Kind, q: Column) -> Column:
    if isinstance(known(kind), tuple):
        return F.struct(*(dual(k, q[c]).alias(c) for k, c in zip(kind, "ab")))
    return checked("u1", -q.cast("bigint")).cast("int") if kind == "u1" else q


def directed(kind: Kind, q: Column, direction: int) -> Column:
    """The sector as it counts for the flux: its dual on a leg that points inward."""
    return q if direction > 0 else dual(kind, q)


def checked(kind: str, q: Column) -> Column:
    """The sector, or an error where it isn't one: Z2 has 0 and 1, and U1 charges are 32-bit."""
    ok = q.isin(0, 1) if kind == "z2" else q.between(LOW, HIGH)
    return F.when(ok, q).otherwise(F.raise_error(F.lit(f"no sector of {kind}")).cast("bigint"))


def fuse_pairs(kinds: tuple[str, str], parts: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Of sectors that are pairs of columns, each of its own kind: fused part by part."""
    first, second = (fuse(kind, [p[k] for p in parts]) for k, kind in enumerate(kinds))
    return first, second
