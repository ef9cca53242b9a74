"""One query for each operator over the business tables, with DuckDB SQL for the same rows.

Inputs are whole numbers, so sums are exact in any order; factorizations are shown by what doesn't depend on signs
or order of vectors, rounded to the whole numbers that they must give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.site_ops import applied, site_operator
from ..operators import blocks, chains, complexes, contract, elementwise, factorize, krylov, sketch, structural, tall, tiles
from ..sources import container
from ..sources.storage import stored
from ..sources.tables import load, load_blocks, quantities, read, save, save_blocks, shared_path
from ..streaming.running import windowed_sums
from ..tensor import Tensor, eye, from_table, from_values, ones, zeros

FLAG = "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end"
STATUS = "case l_linestatus when 'F' then 0 else 1 end"
T3 = f"t as (select l_linenumber - 1 as i0, {FLAG} as i1, {STATUS} as i2, sum(cast(l_quantity as bigint))::bigint as v from lineitem group by all)"
SQ = "s as (select l_suppkey % 8 as i0, l_partkey % 8 as i1, sum(cast(l_quantity as bigint))::bigint as v from lineitem group by all)"
GRID = "g as (select a.range as i0, b.range as i1 from range(8) a, range(8) b)"
#: The legs of T3's flags and statuses: charges -1, 0 and 1, and 0 and 1.
Q = {"u1": (-1, 0, 1), "z2": (0, 1)}


def t3(spark: SparkSession, d: str) -> Tensor:
    df = read(spark, d, "lineitem").select((F.col("l_linenumber") - 1).alias("a"), F.expr(FLAG).alias("b"), F.expr(STATUS).alias("c"), F.col("l_quantity").cast("bigint").alias("q"))
    return from_table(df, ["a", "b", "c"], "q", (7, 3, 2))


def square(spark: SparkSession, d: str) -> Tensor:
    df = read(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("a"), (F.col("l_partkey") % 8).alias("b"), F.col("l_quantity").cast("bigint").alias("q"))
    return from_table(df, ["a", "b"], "q", (8, 8))


def symmetric(spark: SparkSession, d: str) -> Tensor:
    s = square(spark, d)
    return elementwise.add_all([Tensor(s.df, s.shape), structural.permute(s, [1, 0])])


def whole(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.round("v").cast("bigint"))


def out(t: Tensor) -> DataFrame:
    return whole(t.df)


def exact(t: Tensor) -> Tensor:
    """Whole numbers as decimals of 38 digits, so that products of several don't overflow."""
    return t.with_values(F.col("v").cast("decimal(38,0)"))


def narrowed(t: Tensor) -> DataFrame:
    """Whole numbers as bigint where all of them fit, as they are (decimals of 38 digits) otherwise; for results of few rows."""
    df = stored(t.df, "wide")
    most = df.agg(F.max(F.abs("v"))).first()[0]
    return df.withColumn("v", F.col("v").cast("bigint")) if most is None or most < 1 << 63 else df


def einsum_chain3(spark: SparkSession, d: str) -> DataFrame:
    """Three factors of sums over all lines, exact also beyond 2^63, where the SQL's own cast fails."""
    t = exact(t3(spark, d))
    return narrowed(contract.einsum("aij,bij,bkl->akl", t, t, t))


def einsum_matmul(spark: SparkSession, d: str) -> DataFrame:
    a, b = quantities(spark, d, ("l_suppkey", "l_partkey")), quantities(spark, d, ("l_partkey", "l_linenumber"))
    n = 1 << 40  # keys bound the extents; nothing of a shape is materialised
    return out(contract.einsum("ij,jk->ik", Tensor(a, (n, n)), Tensor(b, (n, 8))))


#: A matrix for each supplier: lines by seven classes of parts.
BATCH = "b as (select l_suppkey as id, l_linenumber - 1 as i, l_partkey % 7 as j, sum(cast(l_quantity as bigint))::bigint as v from lineitem group by all)"


def batch(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("id"), (F.col("l_linenumber") - 1).cast("bigint").alias("i"), (F.col("l_partkey") % 7).alias("j"), F.col("l_quantity").cast("bigint").alias("q"))
    return df.groupBy("id", "i", "j").agg(F.sum("q").cast("double").alias("v"))


def regular(spark: SparkSession, d: str) -> DataFrame:
    """The batch with ten million more on the diagonals, so that every matrix has an inverse."""
    own = batch(spark, d)
    more = own.select("id").distinct().select("id", F.expr("explode(sequence(0l, 6l))").alias("i")).select("id", "i", F.col("i").alias("j"), F.lit(1e7).alias("v"))
    return own.unionByName(more).groupBy("id", "i", "j").agg(F.sum("v").alias("v"))


def stated(df: DataFrame) -> DataFrame:
    """Elements that aren't zero, as whole numbers."""
    return whole(df).where("v <> 0")


def rebuilt(spark: SparkSession, d: str, f: Callable, left: str, right: str, diagonal: str | None = None) -> DataFrame:
    return stated(factorize.product(f(batch(spark, d), 7, 7), left, right, diagonal))


def eigh_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    own = batch(spark, d)
    both = own.unionByName(own.select("id", F.col("j").alias("i"), F.col("i").alias("j"), "v")).groupBy("id", "i", "j").agg(F.sum("v").alias("v"))
    parts = factorize.eigh(both, 7, 7)
    parts = parts.unionByName(parts.where("part = 'v'").select("id", F.lit("vt").alias("part"), F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return stated(factorize.product(parts, "v", "vt", "w"))


def solve_planted(spark: SparkSession, d: str) -> DataFrame:
    """Regular matrices, their products with x = (1, .., 7), and x again."""
    a = regular(spark, d)
    b = a.groupBy("id", "i").agg(F.sum(F.col("v") * (F.col("j") + 1)).alias("v")).select("id", "i", F.lit(0).cast("bigint").alias("j"), "v")
    return whole(factorize.solve(a, b, 7, 1)).select("id", "i", "v")


def inverse_identity(spark: SparkSession, d: str) -> DataFrame:
    """Regular matrices times their inverses."""
    a = regular(spark, d)
    x = factorize.inverse(a, 7, 7)
    both = x.unionByName(a.select("id", F.lit("a").alias("part"), "i", "j", "v"))
    return stated(factorize.product(both, "a", "x"))


def expm_nilpotent(spark: SparkSession, d: str) -> DataFrame:
    """Of a matrix that leads from lines to classes, and from those on, for each supplier: 1 + n + n n / 2, doubled to be whole.

    Three factors are zero, and every line is in the matrix twice, so both terms have all lines.
    """
    b = batch(spark, d)
    n = b.select("id", F.explode(F.array(F.lit(0), F.lit(7))).alias("k"), "i", "j", "v").select("id", (F.col("i") + F.col("k")).alias("i"), (F.col("j") + F.col("k") + 7).alias("j"), "v")
    return stated(factorize.expm(n, 21, 21).withColumn("v", F.col("v") * 2)).select("id", "i", "j", "v")


def tridiagonal(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's lines on the diagonal and beside it, its eigenvalues and vectors, and the matrix again."""
    own = batch(spark, d).withColumn("j", (F.col("j") > 2).cast("bigint")).groupBy("id", "i", "j").agg(F.sum("v").alias("v"))
    parts = factorize.tridiagonal_eigh(own, 7)
    parts = parts.unionByName(parts.where("part = 'v'").select("id", F.lit("vt").alias("part"), F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return stated(factorize.product(parts, "v", "vt", "w"))


def svd_tall(spark: SparkSession, d: str) -> DataFrame:
    """All embeddings as one tall matrix of whole thousandths, rebuilt from its factors."""
    u, s, v = tall.tall_svd(thousandths(spark, d), "vec_id", "x", 64)
    right = F.lit([[float(y) for y in row] for row in (v * s)])
    row = F.transform(right, lambda r: F.round(F.aggregate(F.zip_with("u", r, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)).cast("bigint"))
    return u.select(F.col("vec_id").cast("bigint").alias("i0"), F.posexplode(row).alias("i1", "v")).select("i0", F.col("i1").cast("bigint").alias("i1"), "v")


def bsp_svd(spark: SparkSession, d: str) -> DataFrame:
    """A tensor whose row sectors are sums of two charges, factored by sector and contracted again."""
    t = charged(spark, d)
    u, values, v = blocks.svd(t, 2)
    back = blocks.contract(blocks.diagonal_scale(u, 2, values), v, [2], [0])
    return stated(back.df).select(*(F.col(c).cast("bigint").alias(c) for c in back.coords), "v")


def charged(spark: SparkSession, d: str) -> blocks.BlockTensor:
    """Quantities by flag and line, status and part, and the sum of their charges and supplier: sectors of different sizes."""
    df = read(spark, d, "lineitem").select(F.expr(FLAG).alias("b0"), F.expr(STATUS).alias("b1"), (F.col("l_linenumber") - 1).cast("bigint").alias("i0"), (F.col("l_partkey") % 3).alias("i1"), "l_suppkey", F.col("l_quantity").cast("bigint").alias("v"))
    df = df.withColumn("b2", F.col("b0") + F.col("b1")).withColumn("i2", F.col("l_suppkey") % (F.col("b2") + 2))
    legs = blocks.Leg(1, Q["u1"], (7, 7, 7)), blocks.Leg(1, Q["z2"], (3, 3)), blocks.Leg(-1, (-1, 0, 1, 2), (2, 3, 4, 5))
    return blocks.from_elements(df.groupBy("b0", "b1", "b2", "i0", "i1", "i2").agg(F.sum("v").alias("v")), legs)


CHARGED = f"c as (select {FLAG} as b0, {STATUS} as b1, {FLAG} + {STATUS} as b2, l_linenumber - 1 as i0, l_partkey % 3 as i1, l_suppkey % ({FLAG} + {STATUS} + 2) as i2, sum(cast(l_quantity as bigint))::bigint as v from lineitem group by all)"


def bsp_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "blocks")
    save_blocks(charged(spark, d), path)
    t = load_blocks(spark, path)
    return whole(t.df).select(*(F.col(c).cast("bigint").alias(c) for c in t.coords), "v")


def complex_square(spark: SparkSession, d: str) -> complexes.ComplexTensor:
    """Quantities as real parts and line numbers as imaginary ones."""
    df = read(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("i0"), (F.col("l_partkey") % 8).alias("i1"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_linenumber").cast("bigint").alias("n"))
    summed = df.groupBy("i0", "i1").agg(F.sum("q").alias("re"), F.sum("n").alias("im"))
    return complexes.to_complex(Tensor(summed.select("i0", "i1", F.col("re").alias("v")), (8, 8)), Tensor(summed.select("i0", "i1", F.col("im").alias("v")), (8, 8)))


CSQ = "q as (select l_suppkey % 8 as i0, l_partkey % 8 as i1, sum(cast(l_quantity as bigint))::bigint as re, sum(l_linenumber)::bigint as im from lineitem group by all)"


def spectrum(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.lit(0).alias("id"), (F.col("p_size") % 5).cast("int").alias("sector"), F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("s"))


def leg(kind: str, direction: int, dims: tuple[int, ...]) -> blocks.Leg:
    return blocks.Leg(direction, Q[kind], dims)


def flagged(spark: SparkSession, d: str, direction: int = 1) -> blocks.BlockTensor:
    """Quantities by flag (the charge of both legs), line and supplier: every row is in an allowed block."""
    df = read(spark, d, "lineitem").select(F.expr(FLAG).alias("b0"), F.expr(FLAG).alias("b1"), (F.col("l_linenumber") - 1).cast("bigint").alias("i0"), (F.col("l_suppkey") % 4).alias("i1"), F.col("l_quantity").cast("bigint").alias("v"))
    summed = df.groupBy("b0", "b1", "i0", "i1").agg(F.sum("v").alias("v"))
    return blocks.from_elements(summed, (blocks.Leg(direction, Q["u1"], (7, 7, 7)), blocks.Leg(-direction, Q["u1"], (4, 4, 4))))


FLAGGED = f"f as (select {FLAG} as b0, {FLAG} as b1, l_linenumber - 1 as i0, l_suppkey % 4 as i1, sum(cast(l_quantity as bigint))::bigint as v from lineitem group by all)"


def bsp_contract(spark: SparkSession, d: str) -> DataFrame:
    a = flagged(spark, d)
    return blocks.contract(a, blocks.dagger(blocks.permute(a, [1, 0])), [1], [0]).df


def bsp_trace(spark: SparkSession, d: str) -> DataFrame:
    a = flagged(spark, d)
    square_ = blocks.contract(a, blocks.dagger(blocks.permute(a, [1, 0])), [1], [0])
    return blocks.trace(square_, 0, 1).df.select("v")


def flux_blocks(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The blocks of three legs whose sizes are numbers of nations by region, and the quantities of lines in those whose numbers they share."""
    sizes = read(spark, d, "nation").groupBy("n_regionkey").count().orderBy("n_regionkey").limit(len(Q[kind])).collect()  # a row for each sector
    dims = tuple(r["count"] for r in sizes)
    df = blocks.allowed_blocks(spark, tuple(blocks.Leg(s, Q[kind], dims) for s in (1, 1, -1)), 0, kind)
    own = read(spark, d, "lineitem").select(*(((F.col(c) % len(dims)).cast("int")).alias(f"b{k}") for k, c in enumerate(("l_suppkey", "l_partkey", "l_orderkey"))), F.col("l_quantity").cast("bigint").alias("q")).groupBy("b0", "b1", "b2").agg(F.sum("q").alias("v"))
    return df.join(own, ["b0", "b1", "b2"], "left").select(*(F.col(c).cast("bigint").alias(c) for c in ("b0", "b1", "b2", "size", "offset")), F.coalesce("v", F.lit(0)).alias("v"))


def flux_sql(kind: str) -> str:
    n, q = len(Q[kind]), (lambda c: f"({c}.k - 1)") if kind == "u1" else (lambda c: f"{c}.k")
    rule = f"{q('a')} + {q('b')} - {q('c')} = 0" if kind == "u1" else f"xor(xor({q('a')}, {q('b')}), {q('c')}) = 0"
    return f"""with r as (select row_number() over (order by n_regionkey) - 1 as k, count(*) as n from nation group by n_regionkey qualify k < {n}),
        b as (select a.k as b0, b.k as b1, c.k as b2, a.n * b.n * c.n as size from r a, r b, r c where {rule}),
        l as (select l_suppkey % {n} as b0, l_partkey % {n} as b1, l_orderkey % {n} as b2, sum(l_quantity)::bigint as v from lineitem group by all),
        o as (select *, (sum(size) over (order by b0, b1, b2) - size)::bigint as "offset" from b)
        select b0::bigint as b0, b1::bigint as b1, b2::bigint as b2, size::bigint as size, "offset", coalesce(v, 0)::bigint as v from o left join l using (b0, b1, b2)"""


def bsp_zeros(spark: SparkSession, d: str) -> DataFrame:
    """Zeros on the legs of `charged` with its elements added, block by block: how many elements, how many that aren't zero, and their sum."""
    t = charged(spark, d)
    both = blocks.zeros(spark, t.legs).df.select(*t.coords, F.col("v").cast("bigint").alias("v")).unionByName(t.df.select(*t.coords, F.col("v").cast("bigint").alias("v")))
    summed = both.groupBy(*t.coords).agg(F.sum("v").alias("v"))
    return summed.groupBy(*(F.col(f"b{k}").cast("bigint").alias(f"b{k}") for k in range(3))).agg(F.count("*").alias("n"), F.sum((F.col("v") != 0).cast("bigint")).alias("full"), F.sum("v").alias("v"))


def filled_sum(spark: SparkSession, d: str) -> DataFrame:
    """The tensor of `t3` plus one of fours of its shape."""
    t = t3(spark, d)
    return out(elementwise.linear_combine([t, elementwise.fill(t, 4)], [1, 1]))


PAIR = ("u1", "z2")


def paired(spark: SparkSession, d: str) -> blocks.BlockTensor:
    """Quantities by flag and status together, a pair of charges on both legs, line and supplier."""
    pair = ((F.expr(FLAG)) * 2 + F.expr(STATUS)).cast("int")
    df = read(spark, d, "lineitem").select(pair.alias("b0"), pair.alias("b1"), (F.col("l_linenumber") - 1).cast("bigint").alias("i0"), (F.col("l_suppkey") % 4).alias("i1"), F.col("l_quantity").cast("bigint").alias("v"))
    both = tuple((q, z) for q in Q["u1"] for z in Q["z2"])
    summed = df.groupBy("b0", "b1", "i0", "i1").agg(F.sum("v").alias("v"))
    return blocks.from_elements(summed, (blocks.Leg(1, both, (7,) * 6), blocks.Leg(-1, both, (4,) * 6)), 0, PAIR)


def bsp_pair_contract(spark: SparkSession, d: str) -> DataFrame:
    """The tensor of pairs, saved and loaded, with its adjoint."""
    path = shared_path(spark, "pairs")
    container.save(paired(spark, d), path)
    a = container.load(spark, path)
    t = blocks.contract(a, blocks.dagger(blocks.permute(a, [1, 0])), [1], [0])
    return t.df.select(*(F.col(c).cast("bigint").alias(c) for c in t.coords), "v")


PAIRED = f"f as (select {FLAG} * 2 + {STATUS} as b, l_linenumber - 1 as i0, l_suppkey % 4 as i1, sum(cast(l_quantity as bigint))::bigint as v from lineitem group by all)"


def complex_adjoint(spark: SparkSession, d: str) -> DataFrame:
    """A block tensor times 2 + 3i with its adjoint, over both legs: one number, 13 times the sum of squares."""
    a = blocks.scale(flagged(spark, d), 2, 3)
    return blocks.contract(a, blocks.dagger(a), [0, 1], [0, 1]).df.select(F.col("re").cast("bigint").alias("re"), F.col("im").cast("bigint").alias("im"))


def container_chains(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "chains")
    container.save(container.Chains(states(spark, d), SITES, bonds=(1, *[2] * (SITES - 1), 1)), path)
    return container.load(spark, path).df


def container_complex(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "complex")
    container.save(complex_square(spark, d), path)
    return container.load(spark, path).df


def value_at(spark: SparkSession, d: str) -> DataFrame:
    """The element at (3, 5) of the square, by itself."""
    return spark.createDataFrame([(int(structural.get(square(spark, d), (3, 5))),)], "v bigint")


def plus(spark: SparkSession, d: str, other: Callable) -> DataFrame:
    """The tensor of `t3` plus one made for its shape."""
    return out(elementwise.add_all([t3(spark, d), other(spark, (7, 3, 2))]))


def block_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Every element of every allowed block as its coordinates' number, plus the quantities of `flagged` there."""
    t = flagged(spark, d)
    made = blocks.from_block_fn(spark, t.legs, lambda b0, b1, i0, i1: (b0 * 1000 + b1 * 100 + i0 * 10 + i1).cast("bigint"))
    both = made.df.select(*t.coords, "v").unionByName(t.df.select(*t.coords, F.col("v").cast("bigint").alias("v")))
    summed = both.groupBy(*t.coords).agg(F.sum("v").alias("v"))
    return summed.select(*(F.col(c).cast("bigint").alias(c) for c in t.coords), "v")


def block_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many elements of `charged` each of its blocks stores, and how many it has."""
    t = charged(spark, d)
    sizes = blocks.allowed_blocks(spark, t.legs, t.flux, t.kind)
    stored_ = t.df.groupBy("b0", "b1", "b2").agg(F.count("*").alias("n"))
    return sizes.join(stored_, ["b0", "b1", "b2"], "left").select(*(F.col(c).cast("bigint").alias(c) for c in ("b0", "b1", "b2", "size")), F.coalesce("n", F.lit(0)).alias("n"))


def one_block(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block(charged(spark, d), (1, 1, 2)).select(*(F.col(c).cast("bigint").alias(c) for c in ("i0", "i1", "i2", "v")))


def chains_from_sites(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers' chains, made of a table for each site, with bonds that are checked."""
    m = states(spark, d)
    sites = [m.where(F.col("site") == k).select("chain", "l", "p", "r", "v") for k in range(SITES)]
    return chains.from_sites(sites, [1, *[2] * (SITES - 1), 1])


def operator_from_sites(spark: SparkSession, d: str) -> DataFrame:
    """Operators of suppliers, made site by site of their chains: diagonal, with the chains' elements."""
    m = states(spark, d)
    sites = [m.where(F.col("site") == k).select("chain", "l", F.col("p").alias("ket"), F.col("p").alias("bra"), "r", "v") for k in range(SITES)]
    return chains.from_sites(sites, [1, *[2] * (SITES - 1), 1], "operator")


def combined_norms(spark: SparkSession, d: str) -> DataFrame:
    """The norm of the square and its transpose together, from their norms."""
    s = square(spark, d)
    return spark.createDataFrame([(round(C.combine_norms(C.norm(s), C.norm(structural.permute(s, [1, 0]))), 3),)], "v double")


def spins(spark: SparkSession, d: str) -> DataFrame:
    """Every site of every chain by the spin operator z, twice its values."""
    m = states(spark, d).select("chain", "site", "l", "p", "r", F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return applied(m, site_operator(spark, "spin_half", "sz")).select("chain", "site", "l", "p", "r", (F.col("re") * 2).cast("bigint").alias("v"))


def square_matrices(spark: SparkSession, d: str) -> DataFrame:
    """The trace of `flagged` times its adjoint, whose row and column sectors are checked to be alike first."""
    a = flagged(spark, d)
    t = blocks.contract(a, blocks.dagger(blocks.permute(a, [1, 0])), [1], [0])
    blocks.square_sectors(t, 1)
    return blocks.trace(t, 0, 1).df.select(F.col("v").cast("bigint").alias("v"))


def finite_values(spark: SparkSession, d: str) -> DataFrame:
    """Prices of events as text, of which every tenth is made no number: how many are left of each type, and their cents."""
    text = F.when(F.col("event_id") % 10 == 0, F.when(F.col("event_id") % 20 == 0, "nan").otherwise("inf")).otherwise(F.col("value").cast("string"))
    v = complexes.real_from(text)
    cents = F.sum(F.round(v * 100).cast("bigint"))
    return read(spark, d, "events").groupBy("event_type").agg(F.count(v).alias("n"), cents.alias("v"))


def mps_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Norms of the suppliers' chains, estimated by 64 random columns."""
    return chains.estimated_norms(states(spark, d), SITES, 64)


SITES = 7


def states(spark: SparkSession, d: str) -> DataFrame:
    """A chain of seven sites, one for each line number, for each supplier: bonds of one at the ends and two between, elements from counts of lines."""
    base = read(spark, d, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("chain"), (F.col("l_linenumber") - 1).cast("bigint").alias("site"), (F.col("l_partkey") % 2).alias("l"), (F.col("l_orderkey") % 2).alias("p"), F.expr(STATUS).cast("bigint").alias("r"))
    base = base.select("chain", "site", F.when(F.col("site") == 0, 0).otherwise(F.col("l")).cast("bigint").alias("l"), "p", F.when(F.col("site") == SITES - 1, 0).otherwise(F.col("r")).cast("bigint").alias("r"))
    return base.groupBy("chain", "site", "l", "p", "r").agg((F.count("*") % 3).alias("v"))


STATES = f"m as (select l_suppkey::bigint as chain, l_linenumber - 1 as site, case when l_linenumber = 1 then 0 else l_partkey % 2 end as l, l_orderkey % 2 as p, case when l_linenumber = {SITES} then 0 else {STATUS} end as r, (count(*) % 3)::bigint as v from lineitem group by all)"
AMPLITUDES = (
    f"{STATES}, z as (select m0.chain, " + ", ".join(f"m{k}.p as p{k}" for k in range(SITES)) + ", sum(" + " * ".join(f"m{k}.v" for k in range(SITES)) + ")::bigint as v from m m0 "
    + " ".join(f"join m m{k} on m{k}.chain = m0.chain and m{k}.site = {k} and m{k}.l = m{k - 1}.r" for k in range(1, SITES)) + " where m0.site = 0 group by all)"
)
COUNTED = " + ".join(f"p{k}" for k in range(SITES))


def environment_products(spark: SparkSession, d: str) -> DataFrame:
    """For every bond, the environment left of it times that right of it: each gives the whole value again."""
    m = states(spark, d)
    e = chains.environments(m, chains.total_number(spark, SITES, 2), m, SITES)
    left = e.where("side = 'left' and site > 0").select("chain", "site", "a", "w", "b", F.col("v").alias("x"))
    right = e.where("side = 'right'").select("chain", (F.col("site") + 1).alias("site"), "a", "w", "b", F.col("v").alias("y"))
    joined = left.join(right, ["chain", "site", "a", "w", "b"])
    return joined.groupBy("chain", "site").agg(F.sum(F.col("x") * F.col("y")).cast("bigint").alias("v")).where("v <> 0")


def flipped(spark: SparkSession, d: str) -> DataFrame:
    """Every site of every chain by the qubit operator y: states trade places and values become imaginary."""
    m = states(spark, d).select("chain", "site", "l", "p", "r", F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    out = applied(m, site_operator(spark, "qubit", "y"))
    return out.select("chain", "site", "l", "p", "r", F.col("im").cast("bigint").alias("v"))


def container_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "tensor")
    save(t3(spark, d), path)
    return out(load(spark, path))


def lanczos_min(spark: SparkSession, d: str) -> DataFrame:
    """The smallest eigenvalue of the links of customers and regions: a region with n customers gives the values of the root of n, of either sign."""
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("bigint").alias("y"))
    c = read(spark, d, "customer").join(F.broadcast(nation), "c_nationkey").select((F.col("c_custkey") + 5).cast("bigint").alias("x"), "y")
    n = c.agg(F.max("x")).first()[0] + 1
    links = c.select(F.col("x").alias("i"), F.col("y").alias("j")).unionByName(c.select(F.col("y").alias("i"), F.col("x").alias("j")))
    value, _ = krylov.lanczos_smallest(stored(links.withColumn("v", F.lit(1.0)), "links"), n, steps=12, tol=1e-8)
    return spark.createDataFrame([(round(value, 6),)], "v double")


def ground_state(spark: SparkSession, d: str) -> DataFrame:
    """The lowest state of a site for each order priority, in a field along z of its filled orders and along x of its open ones.

    The operator is a sum of terms and never stored; the second row is the residual of the vector, by joins.
    """
    status = F.col("o_orderstatus")
    got = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum((status == "F").cast("int")).alias("z"), F.sum((status == "O").cast("int")).alias("x")).orderBy("o_orderpriority").collect()  # a row for each site
    total = sum(r["z"] + r["x"] for r in got)
    h = krylov.site_sum([t for s, r in enumerate(got) for t in ((0, 1 << s, r["z"] / total), (1 << s, 0, r["x"] / total))])
    value, _, vector = krylov.lowest(h, krylov.random_vector(spark, 1 << len(got)), steps=40, basis_size=10, keep=4, tol=1e-9)
    vector = stored(vector, "state")
    rest = h(vector).unionByName(vector.select("i", (F.col("v") * -value).alias("v"))).groupBy("i").agg(F.sum("v").alias("v"))
    return spark.createDataFrame([("energy", round(value, 6)), ("residual", round(krylov.size_of(rest), 6))], "part string, v double")


def expm_action(spark: SparkSession, d: str) -> DataFrame:
    """Orders of customers, carried to nations and on to regions by the exponential of the links: 1, 1 and 1/2 of the sums, doubled to be whole."""
    b = read(spark, d, "orders").groupBy((F.col("o_custkey") + 30).cast("bigint").alias("i")).agg(F.count("*").cast("double").alias("v"))
    up = read(spark, d, "customer").select((F.col("c_nationkey") + 5).cast("bigint").alias("i"), (F.col("c_custkey") + 30).cast("bigint").alias("j"))
    up = up.unionByName(read(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("i"), (F.col("n_nationkey") + 5).cast("bigint").alias("j")))
    y, _ = krylov.exponential_action(krylov.matrix(stored(up.withColumn("v", F.lit(1.0)), "links")), b, steps=6)
    return whole(y.withColumn("v", F.col("v") * 2)).where("v <> 0")


def solve_sparse(spark: SparkSession, d: str) -> DataFrame:
    """The Laplacian of customers' and nations' links plus one, its product with a planted vector, and the vector again."""
    c = read(spark, d, "customer").select((F.col("c_custkey") + 25).cast("bigint").alias("x"), F.col("c_nationkey").cast("bigint").alias("y"))
    links = c.select(F.col("x").alias("i"), F.col("y").alias("j")).unionByName(c.select(F.col("y").alias("i"), F.col("x").alias("j")))
    nodes = c.select(F.col("x").alias("i")).unionByName(read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("i")))
    diagonal = nodes.join(links.groupBy("i").count(), "i", "left").select("i", (F.coalesce("count", F.lit(0)) + 1).cast("double").alias("v"))
    a = stored(links.withColumn("v", F.lit(-1.0)).unionByName(diagonal.select("i", F.col("i").alias("j"), "v")), "laplacian")
    planted = nodes.select("i", (F.col("i") % 10 + 1).cast("double").alias("v"))
    x, _, _ = krylov.solve(krylov.matrix(a), krylov.matvec(a, planted), diagonal, tol=1e-11)
    return whole(x)


def einsum_tiled(spark: SparkSession, d: str) -> DataFrame:
    """The rows of einsum_matmul by tiles of 64 suppliers, 256 parts and 8 lines; sums of doubles, nothing rounded."""
    top = read(spark, d, "lineitem").agg(F.max("l_suppkey"), F.max("l_partkey")).first()
    m, n = top[0] + 1, top[1] + 1
    a = tiles.tiled(Tensor(quantities(spark, d, ("l_suppkey", "l_partkey")), (m, n)), (64, 256))
    b = tiles.tiled(Tensor(quantities(spark, d, ("l_partkey", "l_linenumber")), (n, 8)), (256, 8))
    return tiles.untiled(tiles.einsum("ij,jk->ik", a, b)).df


def rounded(v, digits: int):
    """Rounded, and zero without a sign."""
    return F.round(v, digits) + F.lit(0.0)


def qr_tall(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as they are: Q times R is the table, Q's columns are orthonormal, and R's products are the table's."""
    rows = read(spark, d, "embeddings").select("vec_id", "embedding")
    q, r = tall.tall_qr(rows, "vec_id", "embedding", 64)
    q = stored(q, "q")
    back = tall.times(q, "vec_id", "q", 64, r, name="x").select(F.lit("x").alias("part"), F.col("vec_id").cast("bigint").alias("i0"), F.posexplode("x").alias("i1", "v"))
    one = C.gram(q, "q", 64).df.select(F.lit("q").alias("part"), "i0", "i1", "v")
    rr = spark.createDataFrame([("r", i, j, float(x)) for i, row in enumerate(r.T @ r) for j, x in enumerate(row)], "part string, i0 bigint, i1 bigint, v double")
    return back.unionByName(one).unionByName(rr).select("part", "i0", F.col("i1").cast("bigint").alias("i1"), rounded("v", 6).alias("v"))


def nation_parts(spark: SparkSession, d: str) -> DataFrame:
    supplier = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("i"))
    rows = read(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")).join(supplier, "l_suppkey")
    return rows.groupBy("i", "j").agg(F.sum("v").alias("v"))


def svd_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by suppliers' nation and part, a matrix of rank 25 at most, at its elements from its factors; the squares of its values sum up to its own."""
    a = nation_parts(spark, d)
    u, s, w = sketch.sparse_svd(a, 25, more=7, powers=1)
    scaled = F.zip_with("u", F.lit([float(x) for x in s]), lambda x, y: x * y)
    value = F.aggregate(F.zip_with("su", "w", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    at = a.select("i", "j").join(u.select("i", scaled.alias("su")), "i").join(w, "j").select(F.col("i").alias("i0"), F.col("j").alias("i1"), F.round(value).cast("bigint").alias("v"))
    return at.unionByName(spark.createDataFrame([(-1, -1, round(float((s * s).sum())))], "i0 bigint, i1 bigint, v bigint"))


def svd_leading(spark: SparkSession, d: str) -> DataFrame:
    """The five largest values of quantities by supplier and part, to four digits of the largest."""
    a = quantities(spark, d, ("l_suppkey", "l_partkey")).select(F.col("i0").alias("i"), F.col("i1").alias("j"), "v")
    _, s, _ = sketch.sparse_svd(a, 5, more=15, powers=3)
    return spark.createDataFrame([(k, float(f"{x:.4g}")) for k, x in enumerate(s)], "k int, v double")


def truncated_target(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of all parts, of which the smallest go while the norm of what goes is at most 300."""
    return factorize.truncated(spectrum(spark, d), target=300.0).select("sector", "k", "s", F.col("rank").cast("bigint").alias("rank"), "kept")


def mps_sum(spark: SparkSession, d: str) -> DataFrame:
    """Chains of suppliers that share a number without its last bit, once and twice: the amplitudes of their sums."""
    m = states(spark, d)
    chain, term = F.shiftright("chain", 1), F.col("chain").bitwiseAND(F.lit(1))
    terms = m.select(chain.alias("chain"), term.alias("term"), "site", "l", "p", "r", "v")
    weights = terms.select("chain", "term").distinct().withColumn("weight", F.col("term") + 1)
    return chains.amplitudes(chains.weighted_sum(terms, weights, SITES), SITES).where("v <> 0")


def thousandths(spark: SparkSession, d: str) -> DataFrame:
    """vec_id and x: embeddings as whole thousandths."""
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000)).alias("x"))


C = contract
E = elementwise
S = structural

#: name: (query, SQL or None)
CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "einsum_matmul": (einsum_matmul, "with a as (select l_suppkey i, l_partkey j, sum(cast(l_quantity as bigint)) v from lineitem group by all), b as (select l_partkey j, l_linenumber k, sum(cast(l_quantity as bigint)) v from lineitem group by all) select i::bigint as i0, k::bigint as i1, sum(a.v * b.v)::bigint as v from a join b using (j) group by all"),
    "einsum_chain3": (einsum_chain3, f"with {T3}, x as (select a.i0 a, b.i0 b, sum(a.v * b.v) v from t a join t b using (i1, i2) group by all) select x.a::bigint as i0, c.i1::bigint as i1, c.i2::bigint as i2, sum(x.v * c.v)::bigint as v from x join t c on c.i0 = x.b group by all"),
    "einsum_batched": (lambda s, d: out(C.einsum("bij,bkj->bik", t3(s, d), t3(s, d))), f"with {T3} select a.i0::bigint as i0, a.i1::bigint as i1, b.i1::bigint as i2, sum(a.v * b.v)::bigint as v from t a join t b on a.i0 = b.i0 and a.i2 = b.i2 group by all"),
    "einsum_hadamard": (lambda s, d: out(C.einsum("ij,ij->ij", square(s, d), S.permute(square(s, d), [1, 0]))), f"with {SQ} select a.i0::bigint as i0, a.i1::bigint as i1, a.v * b.v as v from s a join s b on a.i0 = b.i1 and a.i1 = b.i0"),
    "contract": (lambda s, d: out(C.contract(t3(s, d), t3(s, d), "abc,dbc->da")), f"with {T3} select b.i0::bigint as i0, a.i0::bigint as i1, sum(a.v * b.v)::bigint as v from t a join t b on a.i1 = b.i1 and a.i2 = b.i2 group by all"),
    "tensordot": (lambda s, d: out(C.tensordot(t3(s, d), t3(s, d), [0], [0])), f"with {T3} select a.i1::bigint as i0, a.i2::bigint as i1, b.i1::bigint as i2, b.i2::bigint as i3, sum(a.v * b.v)::bigint as v from t a join t b on a.i0 = b.i0 group by all"),
    "outer_product": (lambda s, d: out(C.tensordot(C.einsum("ij,j->i", square(s, d), from_values(s, [1] * 8, (8,))), C.einsum("ij,j->i", square(s, d), from_values(s, [1] * 8, (8,))), [], [])), f"with {SQ}, r as (select i0, sum(v) v from s group by all) select a.i0::bigint as i0, b.i0::bigint as i1, (a.v * b.v)::bigint as v from r a, r b"),
    "trace_full": (lambda s, d: out(C.trace(square(s, d), [(0, 1)])), f"with {SQ} select sum(v)::bigint as v from s where i0 = i1"),
    "trace_partial": (lambda s, d: out(C.trace(S.stack([square(s, d), S.permute(square(s, d), [1, 0])], 0), [(1, 2)])), f"with {SQ} select k.range::bigint as i0, sum(v)::bigint as v from s, range(2) k where i0 = i1 group by all"),
    "einsum_trace": (lambda s, d: out(C.einsum("abb->a", S.stack([square(s, d), S.permute(square(s, d), [1, 0])], 0))), f"with {SQ} select k.range::bigint as i0, sum(v)::bigint as v from s, range(2) k where i0 = i1 group by all"),
    "inner": (lambda s, d: C.inner(square(s, d), symmetric(s, d)).select(F.col("v").cast("bigint")), f"with {SQ} select sum(a.v * (a.v + coalesce(b.v, 0)))::bigint as v from s a left join s b on a.i0 = b.i1 and a.i1 = b.i0"),
    "norm_safe": (lambda s, d: s.createDataFrame([(round(C.norm(E.scale(square(s, d), 1e150)) / 1e150, 3),)], "v double"), f"with {SQ} select round(sqrt(sum(v * v)::double), 3) as v from s"),
    "diag_extract": (lambda s, d: out(S.diag(square(s, d))), f"with {SQ} select i0::bigint as i0, v from s where i0 = i1"),
    "diag_build": (lambda s, d: out(S.diag(S.diag(square(s, d)))), f"with {SQ} select i0::bigint as i0, i1::bigint as i1, v from s where i0 = i1"),
    "permute": (lambda s, d: out(S.permute(t3(s, d), [2, 0, 1])), f"with {T3} select i2::bigint as i0, i0::bigint as i1, i1::bigint as i2, v from t"),
    "reshape_c": (lambda s, d: out(S.reshape(t3(s, d), (6, 7))), f"with {T3}, x as (select (i0 * 3 + i1) * 2 + i2 f, v from t) select (f // 7)::bigint as i0, (f % 7)::bigint as i1, v from x"),
    "reshape_f": (lambda s, d: out(S.reshape(t3(s, d), (6, 7), "F")), f"with {T3}, x as (select i0 + 7 * (i1 + 3 * i2) f, v from t) select (f % 6)::bigint as i0, (f // 6)::bigint as i1, v from x"),
    "fuse_legs": (lambda s, d: out(S.fuse_legs(t3(s, d), 1, 2)), f"with {T3} select i0::bigint as i0, (i1 * 2 + i2)::bigint as i1, v from t"),
    "split_leg": (lambda s, d: out(S.split_leg(square(s, d), 1, (2, 4))), f"with {SQ} select i0::bigint as i0, (i1 // 4)::bigint as i1, (i1 % 4)::bigint as i2, v from s"),
    "slice": (lambda s, d: out(S.slice_ranges(square(s, d), [(2, 6), (0, 3)])), f"with {SQ} select (i0 - 2)::bigint as i0, i1::bigint as i1, v from s where i0 >= 2 and i0 < 6 and i1 < 3"),
    "expand": (lambda s, d: out(S.expand(S.slice_ranges(square(s, d), [(0, 7), (0, 6)]), [(1, 0), (0, 2)]).complete()), f"with {SQ}, {GRID} select g.i0::bigint as i0, g.i1::bigint as i1, coalesce(s.v, 0)::bigint as v from g left join (select i0 + 1 as i0, i1, v from s where i0 < 7 and i1 < 6) s on g.i0 = s.i0 and g.i1 = s.i1"),
    "replace_slice": (lambda s, d: out(S.replace_slice(square(s, d), S.slice_ranges(square(s, d), [(0, 2), (0, 2)]), (6, 6))), f"with {SQ} select i0::bigint as i0, i1::bigint as i1, v from s where not (i0 >= 6 and i1 >= 6) union all select (i0 + 6)::bigint, (i1 + 6)::bigint, v from s where i0 < 2 and i1 < 2"),
    "set_value": (lambda s, d: out(S.set_value(square(s, d), (1, 1), 5)), f"with {SQ} select i0::bigint as i0, i1::bigint as i1, case when i0 = 1 and i1 = 1 then 5 else v end as v from s"),
    "concatenate": (lambda s, d: out(S.concatenate([square(s, d), square(s, d)], 1)), f"with {SQ} select i0::bigint as i0, (i1 + 8 * k.range)::bigint as i1, v from s, range(2) k"),
    "stack": (lambda s, d: out(S.stack([square(s, d), square(s, d)], 1)), f"with {SQ} select i0::bigint as i0, k.range::bigint as i1, i1::bigint as i2, v from s, range(2) k"),
    "scale": (lambda s, d: out(E.scale(square(s, d), 3)), f"with {SQ} select i0::bigint as i0, i1::bigint as i1, 3 * v as v from s"),
    "map_with_index": (lambda s, d: out(E.map_with_index(square(s, d), lambda i, j, v: v * (i - j))), f"with {SQ} select i0::bigint as i0, i1::bigint as i1, v * (i0 - i1) as v from s"),
    "linear_combine": (lambda s, d: out(E.linear_combine([square(s, d), S.permute(square(s, d), [1, 0])], [2, -1])), f"with {SQ}, u as (select i0, i1, 2 * v as v from s union all select i1, i0, -v from s) select i0::bigint as i0, i1::bigint as i1, sum(v)::bigint as v from u group by all"),
    "add_all": (lambda s, d: out(symmetric(s, d)), f"with {SQ}, u as (select i0, i1, v from s union all select i1, i0, v from s) select i0::bigint as i0, i1::bigint as i1, sum(v)::bigint as v from u group by all"),
    "diagonal_scale": (lambda s, d: out(E.diagonal_scale(square(s, d), 1, from_values(s, list(range(8)), (8,)))), f"with {SQ} select i0::bigint as i0, i1::bigint as i1, v * i1 as v from s"),
    "normalize": (lambda s, d: E.normalize(square(s, d)).df.withColumn("v", F.round(F.col("v"), 9)), f"with {SQ} select i0::bigint as i0, i1::bigint as i1, round(v / (select sqrt(sum(v * v)::double) from s), 9) as v from s"),
    "gram_embeddings": (lambda s, d: out(C.gram(thousandths(s, d), "x", 64)), "with e as (select vec_id, generate_subscripts(embedding, 1) - 1 as k, round(unnest(embedding)::double * 1000)::bigint as v from embeddings) select a.k::bigint as i0, b.k::bigint as i1, sum(a.v * b.v)::bigint as v from e a join e b using (vec_id) group by all"),
    "svd_tall": (svd_tall, "select vec_id::bigint as i0, (generate_subscripts(embedding, 1) - 1)::bigint as i1, round(unnest(embedding)::double * 1000)::bigint as v from embeddings"),
    "svd_reconstruct": (lambda s, d: rebuilt(s, d, factorize.svd, "u", "vt", "s"), f"with {BATCH} select id::bigint as id, i::bigint as i, j::bigint as j, v from b"),
    "qr_reconstruct": (lambda s, d: rebuilt(s, d, factorize.qr, "q", "r"), f"with {BATCH} select id::bigint as id, i::bigint as i, j::bigint as j, v from b"),
    "lq_reconstruct": (lambda s, d: rebuilt(s, d, factorize.lq, "l", "q"), f"with {BATCH} select id::bigint as id, i::bigint as i, j::bigint as j, v from b"),
    "eigh_reconstruct": (eigh_reconstruct, f"with {BATCH}, u as (select id, i, j, v from b union all select id, j, i, v from b) select id::bigint as id, i::bigint as i, j::bigint as j, sum(v)::bigint as v from u group by all"),
    "eig_trace": (lambda s, d: factorize.eigvals(batch(s, d), 7, 7).where("part = 're'").groupBy("id").agg(F.round(F.sum("v")).cast("bigint").alias("v")), f"with {BATCH} select id::bigint as id, coalesce(sum(v) filter (where i = j), 0)::bigint as v from b group by id"),
    "solve_planted": (solve_planted, f"with {BATCH} select distinct id::bigint as id, range::bigint as i, (range + 1)::bigint as v from b, range(7)"),
    "inverse_identity": (inverse_identity, f"with {BATCH} select distinct id::bigint as id, range::bigint as i, range::bigint as j, 1::bigint as v from b, range(7)"),
    "expm_nilpotent": (expm_nilpotent, f"with {BATCH}, n as (select id, i, j + 7 as j, v from b union all select id, i + 7, j + 14, v from b) select id::bigint as id, i::bigint as i, j::bigint as j, sum(v)::bigint as v from (select distinct id, range as i, range as j, 2 as v from n, range(21) union all select id, i, j, 2 * v from n union all select a.id, a.i, b.j, a.v * b.v from n a join n b on a.id = b.id and a.j = b.i) group by all"),
    "tridiagonal_reconstruct": (tridiagonal, f"with {BATCH}, t as (select id, i, (j > 2)::int as j, sum(v)::bigint as v from b group by all) select id::bigint as id, i::bigint as i, i::bigint as j, v from t where j = 0 union all select id, i, i - 1, v from t where j = 1 and i > 0 union all select id, i - 1, i, v from t where j = 1 and i > 0"),
    "truncated_spectrum": (lambda s, d: factorize.truncated(spectrum(s, d), chi_max=50, kept_only=True).select("sector", "k", "s", F.col("rank").cast("bigint").alias("rank")), "select (p_size % 5)::int as sector, p_partkey as k, p_size::bigint as s, row_number() over (order by p_size desc, p_size % 5, p_partkey) as rank from part qualify rank <= 50"),
    "spectrum_map": (lambda s, d: factorize.map_values(spectrum(s, d), lambda v: v * v + 1).select("sector", "k", "s"), "select (p_size % 5)::int as sector, p_partkey as k, (p_size * p_size + 1)::bigint as s from part"),
    "flux_blocks_u1": (lambda s, d: flux_blocks(s, d, "u1"), flux_sql("u1")),
    "flux_blocks_z2": (lambda s, d: flux_blocks(s, d, "z2"), flux_sql("z2")),
    "bsp_contract": (lambda s, d: bsp_contract(s, d).select(*(F.col(c).cast("bigint").alias(c) for c in ("b0", "b1", "i0", "i1", "v"))), f"with {FLAGGED} select a.b0::bigint as b0, b.b0::bigint as b1, a.i0::bigint as i0, b.i0::bigint as i1, sum(a.v * b.v)::bigint as v from f a join f b on a.b1 = b.b1 and a.i1 = b.i1 group by all"),
    "bsp_trace": (bsp_trace, f"with {FLAGGED} select sum(v * v)::bigint as v from f"),
    "bsp_scale": (lambda s, d: blocks.scale(flagged(s, d), 2).df.select(*(F.col(c).cast("bigint").alias(c) for c in ("b0", "b1", "i0", "i1", "v"))), f"with {FLAGGED} select b0::bigint as b0, b1::bigint as b1, i0::bigint as i0, i1::bigint as i1, 2 * v as v from f"),
    "bsp_fuse": (lambda s, d: blocks.fuse_legs(charged(s, d), 0, 2).df.select(*(F.col(c).cast("bigint").alias(c) for c in ("b0", "b1", "i0", "i1", "v"))), f"with {CHARGED} select b2::bigint as b0, b2::bigint as b1, (case b2 when 1 then case b0 when 0 then 0 else 21 end when 2 then case b0 when 1 then 0 else 21 end else 0 end + i0 * 3 + i1)::bigint as i0, i2::bigint as i1, v from c"),
    "bsp_svd_reconstruct": (bsp_svd, f"with {CHARGED} select b0::bigint as b0, b1::bigint as b1, b2::bigint as b2, i0::bigint as i0, i1::bigint as i1, i2::bigint as i2, v from c"),
    "bsp_roundtrip": (bsp_roundtrip, f"with {CHARGED} select b0::bigint as b0, b1::bigint as b1, b2::bigint as b2, i0::bigint as i0, i1::bigint as i1, i2::bigint as i2, v from c"),
    "bsp_zeros": (bsp_zeros, f"""with {CHARGED}, x as (select b0, b1, b2, count(*) filter (v <> 0) as n_full, sum(v)::bigint as v from c group by all)
        select a.range as b0, b.range as b1, a.range + b.range as b2, (21 * (a.range + b.range + 2))::bigint as n, coalesce(n_full, 0)::bigint as full, coalesce(v, 0)::bigint as v
        from range(3) a, range(2) b left join x on x.b0 = a.range and x.b1 = b.range"""),
    "bsp_pair_contract": (bsp_pair_contract, f"with {PAIRED} select a.b::bigint as b0, b.b::bigint as b1, a.i0::bigint as i0, b.i0::bigint as i1, sum(a.v * b.v)::bigint as v from f a join f b using (b, i1) group by all"),
    "bsp_complex_adjoint": (complex_adjoint, f"with {FLAGGED} select (13 * sum(v * v))::bigint as re, 0::bigint as im from f"),
    "container_chains": (container_chains, f"with {STATES} select chain, site::bigint as site, l::bigint as l, p::bigint as p, r::bigint as r, v from m"),
    "container_complex": (container_complex, f"with {CSQ} select i0::bigint as i0, i1::bigint as i1, re, im from q"),
    "mps_sketch": (mps_sketch, None),
    "get_value": (value_at, f"with {SQ} select coalesce(sum(v), 0)::bigint as v from s where i0 = 3 and i1 = 5"),
    "ones_sum": (lambda s, d: plus(s, d, ones), f"with {T3}, g as (select a.range as i0, b.range as i1, c.range as i2 from range(7) a, range(3) b, range(2) c) select g.i0, g.i1, g.i2, (coalesce(t.v, 0) + 1)::bigint as v from g left join t using (i0, i1, i2)"),
    "zeros_sum": (lambda s, d: plus(s, d, zeros), f"with {T3}, g as (select a.range as i0, b.range as i1, c.range as i2 from range(7) a, range(3) b, range(2) c) select g.i0, g.i1, g.i2, coalesce(t.v, 0)::bigint as v from g left join t using (i0, i1, i2)"),
    "eye_product": (lambda s, d: out(C.einsum("ij,jk->ik", square(s, d), eye(s, 8))), f"with {SQ} select i0::bigint as i0, i1::bigint as i1, v from s"),
    "bsp_from_function": (block_numbers, f"with {FLAGGED} select a.range as b0, a.range as b1, b.range as i0, c.range as i1, (a.range * 1100 + b.range * 10 + c.range + coalesce(f.v, 0))::bigint as v from range(3) a cross join range(7) b cross join range(4) c left join f on f.b0 = a.range and f.i0 = b.range and f.i1 = c.range"),
    "bsp_block_sizes": (block_sizes, f"with {CHARGED}, x as (select b0, b1, count(*) as n from c group by all) select a.range as b0, b.range as b1, a.range + b.range as b2, (21 * (a.range + b.range + 2))::bigint as size, coalesce(n, 0)::bigint as n from range(3) a cross join range(2) b left join x on b0 = a.range and b1 = b.range"),
    "bsp_block": (one_block, f"with {CHARGED} select i0::bigint as i0, i1::bigint as i1, i2::bigint as i2, v from c where b0 = 1 and b1 = 1"),
    "mps_from_sites": (chains_from_sites, f"with {STATES} select chain, site::bigint as site, l::bigint as l, p::bigint as p, r::bigint as r, v from m"),
    "mpo_from_sites": (operator_from_sites, f"with {STATES} select chain, site::bigint as site, l::bigint as l, p::bigint as ket, p::bigint as bra, r::bigint as r, v from m"),
    "combined_norms": (combined_norms, f"with {SQ} select round(sqrt(2 * sum(v * v)::double), 3) as v from s"),
    "site_operator_sz": (spins, f"with {STATES} select chain, site::bigint as site, l::bigint as l, p::bigint as p, r::bigint as r, (case p when 0 then v else -v end)::bigint as v from m"),
    "bsp_square_sectors": (square_matrices, f"with {FLAGGED} select sum(v * v)::bigint as v from f"),
    "finite_values": (finite_values, "select event_type, count(*) filter (event_id % 10 <> 0) as n, sum(round(value * 100)::bigint) filter (event_id % 10 <> 0)::bigint as v from events group by event_type"),
    "bsp_diagonal_scale": (lambda s, d: blocks.diagonal_scale(charged(s, d), 1, s.range(6).select(F.floor(F.col("id") / 3).cast("int").alias("sector"), (F.col("id") % 3).alias("i"), (F.col("id") + 1).alias("w"))).df.groupBy(F.col("b1").cast("bigint").alias("b1"), "i1").agg(F.sum("v").cast("bigint").alias("v")), f"with {CHARGED} select b1::bigint as b1, i1, sum(v * (3 * b1 + i1 + 1))::bigint as v from c group by all"),
    "complex_contract": (lambda s, d: complexes.contract(complex_square(s, d), complexes.conj(complex_square(s, d)), "ij,kj->ik").df, f"with {CSQ} select a.i0::bigint as i0, b.i0::bigint as i1, sum(a.re * b.re + a.im * b.im)::bigint as re, sum(a.im * b.re - a.re * b.im)::bigint as im from q a join q b using (i1) group by all"),
    "conjugate_transpose": (lambda s, d: complexes.conjugate_transpose(complex_square(s, d)).df, f"with {CSQ} select i1::bigint as i0, i0::bigint as i1, re, -im as im from q"),
    "complex_inner": (lambda s, d: complexes.inner(complex_square(s, d), complexes.conjugate_transpose(complex_square(s, d))), f"with {CSQ} select sum(a.re * b.re - a.im * b.im)::bigint as re, sum(-a.re * b.im - a.im * b.re)::bigint as im from q a join q b on a.i0 = b.i1 and a.i1 = b.i0"),
    "complex_parts": (lambda s, d: complexes.real(complexes.scale(complex_square(s, d), 2, 3)).df.join(complexes.imag(complexes.scale(complex_square(s, d), 2, 3)).df.withColumnRenamed("v", "w"), ["i0", "i1"]), f"with {CSQ} select i0::bigint as i0, i1::bigint as i1, 2 * re - 3 * im as v, 3 * re + 2 * im as w from q"),
    "map_values": (lambda s, d: out(E.map_values(square(s, d), lambda v: v * v)), f"with {SQ} select i0::bigint as i0, i1::bigint as i1, v * v as v from s"),
    "fill": (filled_sum, f"with {T3}, g as (select a.range as i0, b.range as i1, c.range as i2 from range(7) a, range(3) b, range(2) c) select g.i0, g.i1, g.i2, (coalesce(t.v, 0) + 4)::bigint as v from g left join t using (i0, i1, i2)"),
    "flat_order": (lambda s, d: out(E.flat_order(t3(s, d), "F")), f"with {T3} select (i0 + 7 * (i1 + 3 * i2))::bigint as i0, v from t"),
    "mps_inner": (lambda s, d: chains.inner(states(s, d), states(s, d), SITES).select("chain", F.col("overlap").cast("bigint").alias("v")), f"with {AMPLITUDES} select chain, coalesce(sum(v * v), 0)::bigint as v from (select distinct chain from m) left join z using (chain) group by all"),
    "mps_norm": (lambda s, d: chains.norm(states(s, d), SITES).select("chain", F.round("norm", 6).alias("v")), f"with {AMPLITUDES} select chain, round(sqrt(coalesce(sum(v * v), 0)::double), 6) as v from (select distinct chain from m) left join z using (chain) group by all"),
    "mps_bond_dims": (lambda s, d: chains.bond_dims(states(s, d)), f"with {STATES} select chain, site::bigint as site, (max(l) + 1)::bigint as left, (max(r) + 1)::bigint as right from m group by all"),
    "mps_not_finite": (lambda s, d: chains.not_finite(states(s, d).withColumn("v", F.when(F.col("v") == 0, float("nan")).otherwise(F.col("v")))), f"with {STATES} select chain, site::bigint as site, count(*) as n from m where v = 0 group by all"),
    "mps_environments": (environment_products, f"with {AMPLITUDES}, x as (select chain, sum(v * v * ({COUNTED}))::bigint as v from z group by all) select chain, range::bigint as site, v from x, range(1, {SITES}) where v <> 0"),
    "site_operator_y": (flipped, f"with {STATES} select chain, site::bigint as site, l::bigint as l, (1 - p)::bigint as p, r::bigint as r, case p when 0 then v else -v end::bigint as v from m"),
    "mps_amplitudes": (lambda s, d: chains.amplitudes(states(s, d), SITES), f"with {AMPLITUDES} select * from z"),
    "mps_total_number": (lambda s, d: chains.braket(states(s, d), chains.total_number(s, SITES, 2), states(s, d), SITES).select("chain", F.col("value").cast("bigint").alias("v")), f"with {AMPLITUDES} select chain, coalesce(sum(v * v * ({COUNTED})), 0)::bigint as v from (select distinct chain from m) left join z using (chain) group by all"),
    "mps_apply_number": (lambda s, d: chains.amplitudes(chains.apply(chains.total_number(s, SITES, 2), states(s, d), 2), SITES).where("v <> 0"), f"with {AMPLITUDES} select chain, {', '.join(f'p{k}' for k in range(SITES))}, (v * ({COUNTED}))::bigint as v from z where v * ({COUNTED}) <> 0"),
    "mps_apply_identity": (lambda s, d: chains.amplitudes(chains.apply(chains.identity(s, SITES, 2), states(s, d), 1), SITES), f"with {AMPLITUDES} select * from z"),
    "lanczos_min": (lanczos_min, "select round(-sqrt(max(n)), 6) as v from (select count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_regionkey)"),
    "ground_state": (ground_state, """with p as (select o_orderpriority, count(*) filter (o_orderstatus = 'F') as z, count(*) filter (o_orderstatus = 'O') as x from orders group by o_orderpriority)
        select 'energy' as part, round(-sum(sqrt(z * z + x * x)) / sum(z + x), 6) as v from p union all select 'residual', 0.0"""),
    "expm_action": (expm_action, """with b as (select o_custkey, count(*) as n from orders group by all), j as (select * from b join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
        select o_custkey::bigint + 30 as i, (2 * n)::bigint as v from b union all select c_nationkey::bigint + 5, (2 * sum(n))::bigint from j group by c_nationkey union all select n_regionkey::bigint, sum(n)::bigint from j group by n_regionkey"""),
    "solve_sparse": (solve_sparse, "select n_nationkey::bigint as i, (n_nationkey % 10 + 1)::bigint as v from nation union all select c_custkey + 25, (c_custkey + 25) % 10 + 1 from customer"),
    "einsum_tiled": (einsum_tiled, "with a as (select l_suppkey i, l_partkey j, sum(l_quantity) v from lineitem group by all), b as (select l_partkey j, l_linenumber k, sum(l_quantity) v from lineitem group by all) select i::bigint as i0, k::bigint as i1, sum(a.v * b.v) as v from a join b using (j) group by all"),
    "qr_tall": (qr_tall, """with e as (select vec_id::bigint as i0, (generate_subscripts(embedding, 1) - 1)::bigint as i1, unnest(embedding)::double as v from embeddings)
        select 'x' as part, i0, i1, round(v, 6) + 0.0::double as v from e union all select 'q', a.range, b.range, case when a.range = b.range then 1.0 else 0.0 end from range(64) a, range(64) b
        union all select 'r', a.i1, b.i1, round(sum(a.v * b.v), 6) + 0.0::double from e a join e b using (i0) group by all"""),
    "svd_sparse": (svd_sparse, """with a as (select s_nationkey::bigint as i0, l_partkey::bigint as i1, sum(l_quantity)::bigint as v from lineitem join supplier on l_suppkey = s_suppkey group by all)
        select * from a union all select -1, -1, sum(v * v)::bigint from a"""),
    "svd_leading": (svd_leading, None),
    "truncated_target": (truncated_target, """with s as (select (p_size % 5)::int as sector, p_partkey as k, p_size::bigint as s from part)
        select sector, k, s, row_number() over (order by s desc, sector, k) as rank,
            sum(s * s) over (order by s, sector desc, k desc rows unbounded preceding) > 90000 or row_number() over (order by s desc, sector, k) = 1 as kept from s"""),
    "mps_sum": (mps_sum, f"with {AMPLITUDES} select chain // 2 as chain, {', '.join(f'p{k}' for k in range(SITES))}, sum(v * (1 + chain % 2))::bigint as v from z group by all having sum(v * (1 + chain % 2)) <> 0"),
    "container_roundtrip": (container_roundtrip, f"with {T3} select i0::bigint as i0, i1::bigint as i1, i2::bigint as i2, v from t"),
    "windowed_sums": (lambda s, d: windowed_sums(read(s, d, "events").withColumn("n", F.lit(1).cast("bigint")), ["event_type"], "n").select(F.col("start").cast("date").alias("day"), "event_type", "v"), "select ts::date as day, event_type, count(*)::bigint as v from events group by all"),
}
