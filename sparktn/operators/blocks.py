"""Block-sparse tensors: legs are split in sectors, and only blocks whose directed sectors fuse to the flux exist.

Legs are small tables (axis, direction, block, sector, dim). Elements are rows of a dense tensor with the block's
coordinates b0, b1, ... beside those in it, so that contraction is one join on block and inner coordinates, and
the joins of blocks that don't exist never happen. Elements are real (v) or complex (re, im). Sectors are whole numbers or
pairs, as the tensor's kind says.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import BlockError
from ..functions import sectors
from ..functions.sectors import Kind, Sector, directed, fuse
from . import factorize

#: Blocks up to which their list is sent to all tasks; longer ones are joined by a shuffle.
SENT = 100_000
#: Elements of a block that one row is spread out to at once.
SPREAD = 1 << 16


@dataclass(frozen=True)
class Leg:
    direction: int
    sectors: tuple[Sector, ...]
    dims: tuple[int, ...]

    def dual(self) -> Leg:
        return replace(self, direction=-self.direction)


@dataclass(frozen=True)
class BlockTensor:
    """df has b0.., i0.., and v, or re and im. A flux of 0 is the identity of any kind."""

    df: DataFrame
    legs: tuple[Leg, ...]
    flux: Sector = 0
    kind: Kind = "u1"

    def __post_init__(self) -> None:
        object.__setattr__(self, "flux", flux_of(self.kind, self.flux))
        if self.df.columns not in ([*self.coords, "v"], [*self.coords, "re", "im"]):
            raise BlockError(f"columns {self.df.columns} don't fit {len(self.legs)} legs")

    @property
    def rank(self) -> int:
        return len(self.legs)

    @property
    def coords(self) -> list[str]:
        return [f"{c}{k}" for c in "bi" for k in range(self.rank)]

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c in ("v", "re", "im")]


def flux_of(kind: Kind, flux: Sector) -> Sector:
    return sectors.identity(kind) if flux == 0 else sectors.valid(kind, flux)


def sent(blocks: DataFrame) -> DataFrame:
    return F.broadcast(blocks) if blocks.limit(SENT + 1).count() <= SENT else blocks


def leg_table(spark: SparkSession, leg: Leg, axis: int, kind: Kind = "u1") -> DataFrame:
    """The leg's blocks, their sectors, which must be of the kind, and sizes."""
    if list(leg.sectors) != sorted(set(leg.sectors)) or len(leg.sectors) != len(leg.dims) or min(leg.dims, default=1) < 1:
        raise BlockError("sectors ascend without repeats and have positive sizes")
    rows = [(b, sectors.valid(kind, q), d) for b, (q, d) in enumerate(zip(leg.sectors, leg.dims))]
    return spark.createDataFrame(rows, f"b{axis} int, q{axis} {sectors.ddl(kind)}, d{axis} int")


def allowed_blocks(spark: SparkSession, legs: tuple[Leg, ...], flux: Sector = 0, kind: Kind = "u1") -> DataFrame:
    """b0, .., d0, .., size and offset of the blocks whose directed sectors fuse to the flux, in order.

    Leg by leg: before the last leg is joined, its sector follows from the others, so candidates of one leg less
    are all that is made.
    """
    flux = sectors.literal(kind, flux_of(kind, flux))
    df = leg_table(spark, legs[0], 0, kind)
    for k, leg in enumerate(legs[1:-1], 1):
        df = df.crossJoin(leg_table(spark, leg, k, kind))
    if len(legs) > 1:
        k = len(legs) - 1
        have = fuse(kind, [directed(kind, F.col(f"q{j}"), leg.direction) for j, leg in enumerate(legs[:-1])])
        need = directed(kind, fuse(kind, [flux, sectors.dual(kind, have)]), legs[-1].direction)
        df = df.withColumn(f"q{k}", need).join(leg_table(spark, legs[-1], k, kind), f"q{k}")
    else:
        df = df.where(directed(kind, F.col("q0"), legs[0].direction) == flux)
    size = F.lit(1).cast("bigint")
    for k in range(len(legs)):
        size = size * F.col(f"d{k}")
    b = [f"b{k}" for k in range(len(legs))]
    df = df.select(*b, *(f"d{k}" for k in range(len(legs))), size.alias("size"))
    return df.withColumn("offset", F.sum("size").over(Window.orderBy(*b)) - F.col("size"))  # of leg metadata, not of data


def from_elements(df: DataFrame, legs: tuple[Leg, ...], flux: Sector = 0, kind: Kind = "u1", drop: bool = False) -> BlockTensor:
    """Of rows b0, .., i0, .., v; a row of a block that the flux forbids, or outside its block, is an error, or is left out with drop."""
    t = BlockTensor(df, legs, flux, kind)
    if not drop:
        return checked_blocks(t)
    names = [f"b{k}" for k in range(len(legs))]
    sizes = allowed_blocks(df.sparkSession, legs, flux, kind).select(*names, *(f"d{k}" for k in range(len(legs))))
    joined = df.join(sent(sizes), names)
    for k in range(len(legs)):
        joined = joined.where((F.col(f"i{k}") >= 0) & (F.col(f"i{k}") < F.col(f"d{k}")))
    return replace(t, df=joined.select(*df.columns))


def from_block_fn(spark: SparkSession, legs: tuple[Leg, ...], value: Callable[..., Column], flux: Sector = 0, kind: Kind = "u1") -> BlockTensor:
    """Every element of every allowed block, as the function of its coordinates b0, .., i0, .. gives it.

    Blocks are spread out in two steps with a shuffle between, so no row holds or makes more than SPREAD elements.
    """
    rank = len(legs)
    blocks = allowed_blocks(spark, legs, flux, kind)
    parts = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(SPREAD).cast("bigint"))))
    dealt = parts.repartition(*(f"b{k}" for k in range(rank)), "part")
    df = dealt.withColumn("at", F.explode(F.sequence("part", F.least(F.col("part") + SPREAD, F.col("size")) - 1)))
    inner, step = [], F.lit(1).cast("bigint")
    for k in reversed(range(rank)):
        inner.append(F.pmod(F.floor(F.col("at") / step), F.col(f"d{k}")).cast("bigint").alias(f"i{k}"))
        step = step * F.col(f"d{k}")
    df = df.select(*(f"b{k}" for k in range(rank)), *reversed(inner))
    return BlockTensor(df.withColumn("v", value(*(F.col(f"{c}{k}") for c in "bi" for k in range(rank)))), legs, flux, kind)


def zeros(spark: SparkSession, legs: tuple[Leg, ...], flux: Sector = 0, kind: Kind = "u1") -> BlockTensor:
    return from_block_fn(spark, legs, lambda *_: F.lit(0.0), flux, kind)


def random(spark: SparkSession, legs: tuple[Leg, ...], seed: int, flux: Sector = 0, kind: Kind = "u1") -> BlockTensor:
    """Uniform in [0, 1), the same for a seed at any partitioning."""
    return from_block_fn(spark, legs, lambda *at: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *at), 11) / float(1 << 53), flux, kind)


def checked_blocks(t: BlockTensor) -> BlockTensor:
    """t whose rows are errors where the flux forbids their block or they lie outside it."""
    names = [f"b{k}" for k in range(t.rank)]
    sizes = allowed_blocks(t.df.sparkSession, t.legs, t.flux, t.kind).select(*names, *(f"d{k}" for k in range(t.rank)))
    joined = t.df.join(sent(sizes), names, "left")
    inside = F.lit(True)
    for k in range(t.rank):
        inside = inside & F.col(f"d{k}").isNotNull() & (F.col(f"i{k}") >= 0) & (F.col(f"i{k}") < F.col(f"d{k}"))
    first = t.values[0]
    v = F.when(inside, F.col(first)).otherwise(F.raise_error(F.lit("an element is outside the allowed blocks")).cast(t.df.schema[first].dataType))
    return replace(t, df=joined.select(*t.coords, v.alias(first), *t.values[1:]))


def block(t: BlockTensor, at: tuple[int, ...]) -> DataFrame:
    """The elements i0, .. and values of one block."""
    if len(at) != t.rank or any(not 0 <= b < len(leg.sectors) for b, leg in zip(at, t.legs)):
        raise BlockError(f"no block {at}")
    df = t.df
    for k, b in enumerate(at):
        df = df.where(F.col(f"b{k}") == b)
    return df.select(*(f"i{k}" for k in range(t.rank)), *t.values)


def contract(a: BlockTensor, b: BlockTensor, axes_a: list[int], axes_b: list[int]) -> BlockTensor:
    """Free legs of a, then those of b; contracted legs have equal sectors and opposite directions.

    Of a full contraction, the result is one number, or no row where the fluxes don't fuse to the identity, as it has no block.
    """
    if a.kind != b.kind or len(axes_a) != len(axes_b) or len(set(axes_a)) != len(axes_a) or len(set(axes_b)) != len(axes_b):
        raise BlockError("tensors of different kinds or unpaired legs")
    for x, y in zip(axes_a, axes_b):
        if a.legs[x] != b.legs[y].dual():
            raise BlockError(f"leg {x} doesn't meet leg {y}")
    free_a, free_b = [k for k in range(a.rank) if k not in axes_a], [k for k in range(b.rank) if k not in axes_b]
    on = [f"c{c}{k}" for c in "bi" for k in range(len(axes_a))]
    left = a.df.select(*(F.col(f"{c}{k}").alias(f"x{c}{n}") for c in "bi" for n, k in enumerate(free_a)), *(F.col(f"{c}{k}").alias(f"c{c}{n}") for c in "bi" for n, k in enumerate(axes_a)), *a.values)
    right = b.df.select(*(F.col(f"{c}{k}").alias(f"x{c}{n + len(free_a)}") for c in "bi" for n, k in enumerate(free_b)), *(F.col(f"{c}{k}").alias(f"c{c}{n}") for c in "bi" for n, k in enumerate(axes_b)), *(F.col(v).alias(f"{v}_2") for v in b.values))
    n = len(free_a) + len(free_b)
    joined = left.join(right, on) if on else left.crossJoin(right)
    if a.values == b.values == ["v"]:
        products = {"v": F.col("v") * F.col("v_2")}
    else:
        re, im, re_2, im_2 = (F.col(v) if v in (*a.values, *(f"{w}_2" for w in b.values)) else F.lit(0) if v.startswith("im") else F.col(v.replace("re", "v")) for v in ("re", "im", "re_2", "im_2"))
        products = {"re": re * re_2 - im * im_2, "im": re * im_2 + im * re_2}
    df = joined.groupBy(*(F.col(f"x{c}{k}").alias(f"{c}{k}") for c in "bi" for k in range(n))).agg(*(F.coalesce(F.sum(p), F.lit(0)).alias(v) for v, p in products.items()))
    flux = sectors.fused(a.kind, a.flux, b.flux)
    if not n and flux != sectors.identity(a.kind):
        df = df.where(F.lit(False))
    return BlockTensor(df, tuple([a.legs[k] for k in free_a] + [b.legs[k] for k in free_b]), flux, a.kind)


def trace(t: BlockTensor, first: int | list[tuple[int, int]], second: int | None = None) -> BlockTensor:
    """Over a pair of legs, or a list of pairs, that are dual to each other; of all legs, like a full contraction."""
    pairs = [(first, second)] if isinstance(first, int) else first
    used = [k for p in pairs for k in p]
    if len(set(used)) != len(used) or any(t.legs[a] != t.legs[b].dual() for a, b in pairs):
        raise BlockError("a trace takes pairs of legs that are dual to each other")
    free = [k for k in range(t.rank) if k not in used]
    same = F.lit(True)
    for a, b in pairs:
        same = same & (F.col(f"b{a}") == F.col(f"b{b}")) & (F.col(f"i{a}") == F.col(f"i{b}"))
    df = t.df.where(same).groupBy(*(F.col(f"{c}{k}").alias(f"{c}{n}") for c in "bi" for n, k in enumerate(free))).agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in t.values))
    if not free and t.flux != sectors.identity(t.kind):
        df = df.where(F.lit(False))
    return BlockTensor(df, tuple(t.legs[k] for k in free), t.flux, t.kind)


def permute(t: BlockTensor, order: list[int]) -> BlockTensor:
    if sorted(order) != list(range(t.rank)):
        raise BlockError("no permutation of the legs")
    return replace(t, df=t.df.select(*(F.col(f"{c}{k}").alias(f"{c}{n}") for c in "bi" for n, k in enumerate(order)), *t.values), legs=tuple(t.legs[k] for k in order))


def scale(t: BlockTensor, factor: float, im: float = 0) -> BlockTensor:
    """Times a number; one with an imaginary part makes a real tensor complex."""
    if t.values == ["v"] and not im:
        return replace(t, df=t.df.withColumn("v", F.col("v") * factor))
    c = to_complex(t)
    return replace(c, df=c.df.select(*t.coords, (F.col("re") * factor - F.col("im") * im).alias("re"), (F.col("re") * im + F.col("im") * factor).alias("im")))


def to_complex(t: BlockTensor) -> BlockTensor:
    return t if t.values != ["v"] else replace(t, df=t.df.select(*t.coords, F.col("v").alias("re"), (F.col("v") * 0).alias("im")))


def dagger(t: BlockTensor) -> BlockTensor:
    """Legs turn around, the flux becomes its dual, and complex elements are conjugated; done twice, it changes nothing."""
    df = t.df.withColumn("im", -F.col("im")) if "im" in t.values else t.df
    return replace(t, df=df, legs=tuple(leg.dual() for leg in t.legs), flux=sectors.dual_of(t.kind, t.flux))


def diagonal_scale(t: BlockTensor, axis: int, weights: DataFrame) -> BlockTensor:
    """Weights (sector, i, w) of each sector along the axis; an element without a weight is an error."""
    leg = t.legs[axis]
    sector = sectors.at(t.kind, leg.sectors, F.col(f"b{axis}"))
    df = t.df.withColumn("sector", sector).join(weights.withColumnRenamed("i", f"i{axis}"), ["sector", f"i{axis}"], "left")
    w = F.when(F.col("w").isNotNull(), F.col("w")).otherwise(F.raise_error(F.lit("a sector or place has no weight")).cast("double"))
    return replace(t, df=df.select(*t.coords, *((F.col(v) * w).alias(v) for v in t.values)))


def fused_leg(t: BlockTensor, first: int, count: int, direction: int = 1) -> tuple[Leg, DataFrame]:
    """The leg that neighbouring legs fuse to, and where each combination of their blocks lies in it."""
    if count < 1 or not 0 <= first <= t.rank - count:
        raise BlockError("neighbouring legs fuse")
    spark, legs = t.df.sparkSession, t.legs[first : first + count]
    df = leg_table(spark, legs[0], 0, t.kind)
    for k, leg in enumerate(legs[1:], 1):
        df = df.crossJoin(leg_table(spark, leg, k, t.kind))
    q = fuse(t.kind, [directed(t.kind, F.col(f"q{k}"), leg.direction) for k, leg in enumerate(legs)])
    size = F.lit(1)
    for k in range(count):
        size = size * F.col(f"d{k}")
    b = [f"b{k}" for k in range(count)]
    df = df.withColumn("q", directed(t.kind, q, direction)).withColumn("size", size)
    df = df.withColumn("start", F.sum("size").over(Window.partitionBy("q").orderBy(*b)) - F.col("size")).withColumn("block", F.dense_rank().over(Window.orderBy("q")) - 1)
    found = df.groupBy("q").agg(F.sum("size").alias("n")).orderBy("q").collect()  # a row for each sector of a leg
    return Leg(direction, tuple(sectors.value(r["q"]) for r in found), tuple(r["n"] for r in found)), df.select(*b, *(f"d{k}" for k in range(count)), "q", "size", "block", "start")


def fuse_legs(t: BlockTensor, first: int, count: int, direction: int = 1) -> BlockTensor:
    leg, where = fused_leg(t, first, count, direction)
    where = where.select(*(F.col(f"b{k}").alias(f"b{first + k}") for k in range(count)), *(F.col(f"d{k}").alias(f"d{first + k}") for k in range(count)), "block", "start")
    at = F.lit(0)
    for k in range(first, first + count):
        at = at * F.col(f"d{k}") + F.col(f"i{k}")
    joined = t.df.join(sent(where), [f"b{k}" for k in range(first, first + count)])
    legs = (*t.legs[:first], leg, *t.legs[first + count :])
    rest = [*range(first), None, *range(first + count, t.rank)]
    df = joined.select(*((F.col("block") if k is None else F.col(f"b{k}")).alias(f"b{n}") for n, k in enumerate(rest)), *((F.col("start") + at if k is None else F.col(f"i{k}")).alias(f"i{n}") for n, k in enumerate(rest)), *t.values)
    return replace(t, df=df, legs=legs)


@dataclass(frozen=True)
class SectorMatrices:
    """The matrices of a tensor whose first legs are rows and whose others are columns, one for each row sector.

    df has id (the row sector's number), i, j, v; sizes has id, m, n; column is the number of the column sector that each row
    sector meets. A row sector without its column sector has no matrix.
    """

    df: DataFrame
    sizes: DataFrame
    rows: Leg
    column: list[int]
    where_rows: DataFrame
    where_columns: DataFrame
    ranks: dict[int, int]


def sector_matrices(t: BlockTensor, nrow: int) -> SectorMatrices:
    """Row sectors q meet column sectors that fuse with them to the flux, so each pair is a matrix of its own size."""
    if not 0 < nrow < t.rank or t.values != ["v"]:
        raise BlockError(f"{nrow} row legs of {t.rank}, or complex elements")
    row, where_rows = fused_leg(t, 0, nrow, 1)
    column, where_columns = fused_leg(t, nrow, t.rank - nrow, -1)
    number = {q: k for k, q in enumerate(column.sectors)}
    off = sectors.dual_of(t.kind, t.flux)
    partner = [number.get(sectors.fused(t.kind, q, off), -1) for q in row.sectors]
    found = [(k, m, column.dims[p]) for k, (m, p) in enumerate(zip(row.dims, partner)) if p >= 0]
    spark = t.df.sparkSession
    sizes = spark.createDataFrame(found, "id bigint, m int, n int")
    df = t.df
    for where, first, count, at in ((where_rows, 0, nrow, "i"), (where_columns, nrow, t.rank - nrow, "j")):
        place = F.lit(0)
        for k in range(count):
            place = place * F.col(f"d{k}") + F.col(f"i{first + k}")
        on = where.select(*(F.col(f"b{k}").alias(f"b{first + k}") for k in range(count)), *(f"d{k}" for k in range(count)), "start", F.col("block").alias(f"block_{at}"))
        df = df.join(sent(on), [f"b{first + k}" for k in range(count)]).withColumn(f"at_{at}", F.col("start") + place).drop("start", *(f"d{k}" for k in range(count)))
    df = df.select(F.col("block_i").cast("bigint").alias("id"), F.col("at_i").cast("bigint").alias("i"), F.col("at_j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
    return SectorMatrices(df, sizes, row, partner, where_rows, where_columns, {k: min(m, n) for k, m, n in found})


def to_legs(part: DataFrame, where: DataFrame, count: int, axis: str, first: int, m: SectorMatrices) -> DataFrame:
    """A factor's elements (id, i, j, v) with the fused axis split in its legs' blocks and places again, numbered from `first`."""
    number = F.col("id") if axis == "i" else F.element_at(F.lit(m.column), (F.col("id") + 1).cast("int"))
    inside = (number == F.col("block")) & (F.col(axis) >= F.col("start")) & (F.col(axis) < F.col("start") + F.col("size"))
    df = part.join(sent(where), inside).withColumn("at", F.col(axis) - F.col("start"))
    inner, step = [], F.lit(1).cast("bigint")
    for k in reversed(range(count)):
        inner.append(F.pmod(F.floor(F.col("at") / step), F.col(f"d{k}")).cast("bigint").alias(f"i{first + k}"))
        step = step * F.col(f"d{k}")
    bond = F.array_position(F.lit(sorted(m.ranks)), F.col("id").cast("int")).cast("int") - 1
    k, other = (count, "j") if axis == "i" else (0, "i")
    return df.select(*(F.col(f"b{n}").alias(f"b{first + n}") for n in range(count)), bond.alias(f"b{k}"), *inner, F.col(other).alias(f"i{k}"), "v")


def svd(t: BlockTensor, nrow: int) -> tuple[BlockTensor, DataFrame, BlockTensor]:
    """U (row legs and a bond), the values (sector, i, w) and V (the bond and column legs) of every sector's matrix at once."""
    m = sector_matrices(t, nrow)
    parts = factorize.svd(m.df, m.sizes)
    bond = Leg(-1, tuple(m.rows.sectors[k] for k in sorted(m.ranks)), tuple(m.ranks[k] for k in sorted(m.ranks)))
    legs = (*t.legs[:nrow], bond), (bond.dual(), *t.legs[nrow:])
    names = [[f"{c}{k}" for c in "bi" for k in range(len(x))] for x in legs]
    u = to_legs(parts.where("part = 'u'"), m.where_rows, nrow, "i", 0, m).select(*names[0], "v")
    v = to_legs(parts.where("part = 'vt'"), m.where_columns, t.rank - nrow, "j", 1, m).select(*names[1], "v")
    values = parts.where("part = 's'").select(sectors.at(t.kind, m.rows.sectors, F.col("id")).alias("sector"), "i", F.col("v").alias("w"))
    return BlockTensor(u, legs[0], 0, t.kind), values, BlockTensor(v, legs[1], t.flux, t.kind)


def square_sectors(t: BlockTensor, nrow: int) -> None:
    """An error unless every row sector meets a column sector of its size."""
    m = sector_matrices(t, nrow)
    found = {r["id"]: (r["m"], r["n"]) for r in m.sizes.collect()}  # a row for each sector
    if set(found) != set(range(len(m.rows.sectors))) or any(a != b for a, b in found.values()):
        raise BlockError("row and column sectors differ")
