"""Chains of tensors (matrix-product states and operators) in many copies: folds of joins and sums over the sites.

A table of chains has columns chain, site, l, p, r, v (states) or chain, site, l, ket, bra, r, v (operators).
A fold keeps an environment of two or three bonds for each chain, so all chains advance together, dealt by chain
and bond; the number of stages follows the length of a chain, not how many there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TensorError
from ..functions.prefix import prefix_sums
from ..sources.storage import stored
from .sketch import uniform

#: Sites after which a fold's environment is written, so that plans stay short however long a chain is.
STORED = 8
#: Random columns of a sketch that one row holds.
WIDE = 16


def from_sites(sites: list[DataFrame], bonds: list[int] | None = None, kind: str = "state") -> DataFrame:
    """A table of chains from one table (chain, l, p, r, v), or (chain, l, ket, bra, r, v), for each site.

    With bonds (one more than sites, from edge to edge), an element beyond its bond is an error.
    """
    names = ["l", "p", "r"] if kind == "state" else ["l", "ket", "bra", "r"]
    if not sites or bonds is not None and len(bonds) != len(sites) + 1:
        raise TensorError("a chain has sites, and bonds at both sides of each")
    out = None
    for k, df in enumerate(sites):
        if set(df.columns) != {"chain", *names, "v"}:
            raise TensorError(f"columns {df.columns} of site {k} aren't those of a chain's {kind}")
        own = df.select("chain", F.lit(k).cast("bigint").alias("site"), *names, "v")
        if bonds is not None:
            inside = (F.col("l") >= 0) & (F.col("l") < bonds[k]) & (F.col("r") >= 0) & (F.col("r") < bonds[k + 1])
            own = own.withColumn("v", F.when(inside, F.col("v")).otherwise(F.raise_error(F.lit(f"an element of site {k} is beyond its bond")).cast(df.schema["v"].dataType)))
        out = own if out is None else out.unionByName(own)
    return out


def bond_dims(chains: DataFrame) -> DataFrame:
    """chain, site, left, right: the bonds that the stored elements reach; the largest is their maximum."""
    return chains.groupBy("chain", "site").agg((F.max("l") + 1).alias("left"), (F.max("r") + 1).alias("right"))


def not_finite(chains: DataFrame) -> DataFrame:
    """chain, site and how many of its elements are null, NaN or infinite; no rows if all are numbers."""
    v = F.col("v").cast("double")
    return chains.where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).groupBy("chain", "site").agg(F.count("*").alias("n"))


def by_site(*tables: DataFrame) -> list[DataFrame]:
    """The tables, each written once by site, so that a fold computes them once and reads each site's rows alone."""
    made = {id(t): t for t in tables}  # a state that is both bra and ket is written once
    made = {k: stored(t, "sites", "site") for k, t in made.items()}
    return [made[id(t)] for t in tables]


def short(env: DataFrame, k: int) -> DataFrame:
    return stored(env, "environment") if k % STORED == STORED - 1 else env


def inner(bra: DataFrame, ket: DataFrame, n: int) -> DataFrame:
    """chain and overlap of real states with n sites; chains whose overlap has no term are 0."""
    bra, ket = by_site(bra, ket)
    env = bra.select("chain").distinct().select("chain", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(1).alias("v"))
    for k in range(n):
        left = bra.where(F.col("site") == k).select("chain", F.col("l").alias("a"), "p", F.col("r").alias("c"), F.col("v").alias("x"))
        right = ket.where(F.col("site") == k).select("chain", F.col("l").alias("b"), "p", F.col("r").alias("d"), F.col("v").alias("y"))
        half = env.join(left, ["chain", "a"]).groupBy("chain", "b", "p", "c").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
        env = short(half.join(right, ["chain", "b", "p"]).groupBy("chain", F.col("c").alias("a"), F.col("d").alias("b")).agg(F.sum(F.col("v") * F.col("y")).alias("v")), k)
    return closed(bra, env, "overlap")


def norm(state: DataFrame, n: int) -> DataFrame:
    """chain and norm of real states."""
    return inner(state, state, n).select("chain", F.sqrt("overlap").alias("norm"))


def closed(bra: DataFrame, env: DataFrame, name: str) -> DataFrame:
    chains = bra.select("chain").distinct()
    return chains.join(env.groupBy("chain").agg(F.sum("v").alias("v")), "chain", "left").select("chain", F.coalesce("v", F.lit(0)).alias(name))


def edge(bra: DataFrame) -> DataFrame:
    one = F.lit(0).cast("bigint")
    return bra.select("chain").distinct().select("chain", one.alias("a"), one.alias("w"), one.alias("b"), F.lit(1).cast("bigint").alias("v"))


def step(env: DataFrame, bra: DataFrame, op: DataFrame, ket: DataFrame, k: int, near: str = "l", far: str = "r") -> DataFrame:
    """The environment (chain, a, w, b, v) carried over site k: from the bonds `near` to the bonds `far`."""
    left = bra.where(F.col("site") == k).select("chain", F.col(near).alias("a"), F.col("p").alias("bra"), F.col(far).alias("a2"), F.col("v").alias("x"))
    mid = op.where(F.col("site") == k).select(F.col(near).alias("w"), "ket", "bra", F.col(far).alias("w2"), F.col("v").alias("o"))
    right = ket.where(F.col("site") == k).select("chain", F.col(near).alias("b"), F.col("p").alias("ket"), F.col(far).alias("b2"), F.col("v").alias("y"))
    env = env.join(left, ["chain", "a"]).groupBy("chain", "w", "b", "bra", "a2").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    env = env.join(mid, ["w", "bra"]).groupBy("chain", "b", "a2", "ket", "w2").agg(F.sum(F.col("v") * F.col("o")).alias("v"))
    return env.join(right, ["chain", "b", "ket"]).groupBy("chain", F.col("a2").alias("a"), F.col("w2").alias("w"), F.col("b2").alias("b")).agg(F.sum(F.col("v") * F.col("y")).alias("v"))


def braket(bra: DataFrame, op: DataFrame, ket: DataFrame, n: int) -> DataFrame:
    """chain and value of the operator between two states."""
    bra, ket = by_site(bra, ket)
    env = edge(bra)
    for k in range(n):
        env = short(step(env, bra, op, ket, k), k)
    return closed(bra, env, "value")


def environments(bra: DataFrame, op: DataFrame, ket: DataFrame, n: int) -> DataFrame:
    """chain, site, side, a, w, b, v: what lies left of every site (`left`) and right of it (`right`), contracted.

    Two folds, each of whose steps is written once, so that all 2 n environments take as many joins as two products.
    """
    if n < 1:
        raise TensorError("an empty chain has no environments")
    bra, ket = by_site(bra, ket)
    out = None
    for side, sites, near, far in (("left", range(n), "l", "r"), ("right", range(n - 1, -1, -1), "r", "l")):
        env = edge(bra)
        for k in sites:
            own = env.select("chain", F.lit(k).cast("bigint").alias("site"), F.lit(side).alias("side"), "a", "w", "b", F.col("v").cast("double").alias("v"))
            out = own if out is None else out.unionByName(own)
            if k != sites[-1]:
                env = stored(step(env, bra, op, ket, k, near, far), "environment")
    return out


def apply(op: DataFrame, state: DataFrame, bonds: int) -> DataFrame:
    """The operator on every chain, exact: site products with fused bonds; `bonds` is the operator's largest bond.

    One join on site and physical index, with no order among sites. A bond of the operator beyond `bonds` is an error.
    """
    inside: Column = (F.col("l") < bonds) & (F.col("r") < bonds)
    op = op.withColumn("v", F.when(inside, F.col("v")).otherwise(F.raise_error(F.lit("a bond of the operator is larger than stated")).cast(op.schema["v"].dataType)))
    o = op.select("site", F.col("l").alias("ol"), "ket", "bra", F.col("r").alias("orr"), F.col("v").alias("o"))
    s = state.select("chain", "site", "l", F.col("p").alias("ket"), "r", "v")
    joined = s.join(o, ["site", "ket"])
    return joined.groupBy("chain", "site", (F.col("l") * bonds + F.col("ol")).alias("l"), F.col("bra").alias("p"), (F.col("r") * bonds + F.col("orr")).alias("r")).agg(F.sum(F.col("v") * F.col("o")).alias("v"))


def identity(spark, n: int, d: int) -> DataFrame:
    return spark.range(n * d).select(F.floor(F.col("id") / d).alias("site"), F.lit(0).cast("bigint").alias("l"), (F.col("id") % d).alias("ket"), (F.col("id") % d).alias("bra"), F.lit(0).cast("bigint").alias("r"), F.lit(1).alias("v"))


def total_number(spark, n: int, d: int) -> DataFrame:
    """The sum over sites of the physical index: bonds 0 (nothing counted yet) and 1 (counted)."""
    sites = spark.range(n).select(F.col("id").alias("site")).crossJoin(spark.range(d).select(F.col("id").alias("k")))
    first, last = F.col("site") == 0, F.col("site") == n - 1
    terms = F.array(
        F.struct(F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(1).alias("v"), (~last).alias("on")),
        F.struct(F.lit(0).alias("l"), F.when(last, 0).otherwise(1).alias("r"), F.col("k").cast("int").alias("v"), F.lit(True).alias("on")),
        F.struct(F.lit(1).alias("l"), F.when(last, 0).otherwise(1).alias("r"), F.lit(1).alias("v"), (~first).alias("on")),
    )
    rows = sites.select("site", "k", F.explode(terms).alias("t")).where("t.on and t.v <> 0")
    return rows.select("site", F.col("t.l").cast("bigint").alias("l"), F.col("k").alias("ket"), F.col("k").alias("bra"), F.col("t.r").cast("bigint").alias("r"), F.col("t.v").alias("v"))


def amplitudes(state: DataFrame, n: int) -> DataFrame:
    """chain, p0, .., v: the state written out, for short chains."""
    (state,) = by_site(state)
    env = state.where("site = 0").select("chain", F.col("p").alias("p0"), F.col("r").alias("b"), "v")
    for k in range(1, n):
        s = state.where(F.col("site") == k).select("chain", F.col("l").alias("b"), F.col("p").alias(f"p{k}"), "r", F.col("v").alias("w"))
        env = env.join(s, ["chain", "b"]).groupBy("chain", *(f"p{j}" for j in range(k + 1)), F.col("r").alias("b")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return env.groupBy("chain", *(f"p{j}" for j in range(n))).agg(F.sum("v").alias("v"))


def weighted_sum(terms: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """The weighted sum of the terms of each chain, exact: bonds side by side, the edges merged.

    terms has chain, term, site, l, p, r, v and weights chain, term, weight (one row each; a term without a weight has none).
    Every inner bond of a chain is as wide as its terms' bonds together; a term's place in a bond is the sum of the widths of
    the terms before it, so chains may have any number of terms. A bond at an edge other than 0 is an error.
    """
    if n < 1:
        raise TensorError("a chain has sites")
    edge_only = ((F.col("site") > 0) | (F.col("l") == 0)) & ((F.col("site") < n - 1) | (F.col("r") == 0))
    v = F.when(edge_only, F.col("v")).otherwise(F.raise_error(F.lit("a chain's edges have bonds of one")).cast(terms.schema["v"].dataType))
    own = stored(terms.select("chain", "term", "site", "l", "p", "r", v.alias("v")), "terms")
    # bond k is right of site k
    ends = own.select("chain", "term", F.explode(F.array(F.struct((F.col("site") - 1).alias("bond"), F.col("l").alias("at")), F.struct(F.col("site").alias("bond"), F.col("r").alias("at")))).alias("e"))
    widths = ends.select("chain", "term", "e.*").where(F.col("bond").between(0, n - 2)).groupBy("chain", "term", "bond").agg((F.max("at") + 1).alias("width"))
    places = prefix_sums(widths, [F.col("term")], {"place": F.col("width")}, by=["chain", "bond"]).drop("width")
    left = places.select("chain", "term", (F.col("bond") + 1).alias("site"), F.col("place").alias("left"))
    right = places.select("chain", "term", F.col("bond").alias("site"), F.col("place").alias("right"))
    joined = own.join(left, ["chain", "term", "site"], "left").join(right, ["chain", "term", "site"], "left")
    weighted = joined.join(weights.select("chain", "term", "weight"), ["chain", "term"])
    zero = F.lit(0).cast("bigint")
    value = F.when(F.col("site") == 0, F.col("v") * F.col("weight")).otherwise(F.col("v"))
    moved = weighted.select("chain", "site", (F.col("l") + F.coalesce("left", zero)).alias("l"), "p", (F.col("r") + F.coalesce("right", zero)).alias("r"), value.alias("v"))
    return moved.groupBy("chain", "site", "l", "p", "r").agg(F.sum("v").alias("v")) if n == 1 else moved


def sketches(state: DataFrame, n: int, columns: int, seed: int = 0) -> DataFrame:
    """chain, site, l, c, v: what lies from every site on to the right, with its physical indices summed against random columns.

    A random column is a product over the sites of normally distributed numbers, each made from a hash of seed, site, index
    and column, so all chains meet the same columns, none is stored, and adding columns changes none there is. One
    join and one sum a site carry all chains and columns on at once. The squares of the rows of site 0 have the squared norm
    as their mean: for sites of two states each, its estimate from k columns is off by a share of the root of
    (3^n - 1) / k, taken as a deviation, at most.
    """
    if n < 1 or columns < 1:
        raise TensorError("a sketch takes sites and columns")
    (state,) = by_site(state)
    zero = F.lit(0).cast("bigint")
    wide = min(WIDE, columns)  # columns of a row; those beyond the last are dropped at the end
    each = F.explode(F.sequence(zero, F.lit((columns - 1) // wide).cast("bigint"))).alias("block")
    env = state.select("chain").distinct().select("chain", zero.alias("r"), each, F.array_repeat(F.lit(1.0), wide).alias("x"))
    out = None
    for k in reversed(range(n)):
        own = state.where(F.col("site") == k).select("chain", "l", "p", "r", "v")

        def drawn(c: int) -> Column:
            at = F.col("block") * wide + c
            return F.sqrt(-2.0 * F.log(uniform(seed, k, 0, F.col("p"), at))) * F.cos(2 * math.pi * uniform(seed, k, 1, F.col("p"), at))

        met = own.join(env, ["chain", "r"])
        summed = met.groupBy("chain", "l", "block").agg(*(F.sum(F.col("v") * F.col("x")[c] * drawn(c)).alias(f"x{c}") for c in range(wide)))
        env = summed.select("chain", "l", "block", F.array(*(f"x{c}" for c in range(wide))).alias("x"))
        env = stored(env, "sketch") if k else env
        rows = env.select("chain", "l", "block", F.posexplode("x").alias("c", "v"))
        rows = rows.select("chain", F.lit(k).cast("bigint").alias("site"), "l", (F.col("block") * wide + F.col("c")).alias("c"), "v").where(F.col("c") < columns)
        out = rows if out is None else out.unionByName(rows)
        env = env.withColumnRenamed("l", "r")
    return out


def estimated_norms(state: DataFrame, n: int, columns: int, seed: int = 0) -> DataFrame:
    """chain and norm, estimated from sketches; a chain without a path is 0."""
    sums = sketches(state, n, columns, seed).where("site = 0").groupBy("chain").agg(F.sum(F.col("v") * F.col("v")).alias("s"))
    chains = state.select("chain").distinct()
    return chains.join(sums, "chain", "left").select("chain", F.sqrt(F.coalesce("s", F.lit(0.0)) / columns).alias("norm"))
