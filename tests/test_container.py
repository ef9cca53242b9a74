"""Containers, pair sectors and complex blocks, sketches of chains."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparktn.errors import BlockError, ContainerError, TensorError
from sparktn.functions import sectors, site_ops
from sparktn.operators import blocks, chains, complexes, elementwise
from sparktn.sources import container
from sparktn.tensor import from_values

PAIR = ("u1", "z2")
NESTED = (PAIR, "u1")
LEGS = blocks.Leg(1, ((-1, 0), (0, 1), (1, 0)), (2, 1, 2)), blocks.Leg(1, ((0, 0), (0, 1)), (3, 2)), blocks.Leg(-1, ((-1, 0), (0, 0), (0, 1), (1, 1)), (2, 3, 1, 2))


def rows(df):
    return sorted(map(tuple, df.collect()))


def objects(spark):
    t = from_values(spark, [1.0, 2.0, 3.0, 4.0], (2, 2))
    state = spark.createDataFrame([(1, k, 0, p, 0, p + 1) for k in range(3) for p in range(2)], "chain bigint, site bigint, l bigint, p bigint, r bigint, v bigint")
    op = state.withColumnRenamed("p", "ket").withColumn("bra", F.col("ket")).select("chain", "site", "l", "ket", "bra", "r", "v")
    pairs = blocks.random(spark, LEGS, 1, 0, PAIR)
    return {"dense": t, "complex": complexes.scale(complexes.to_complex(t), 1, 2), "chains of states": container.Chains(state, 3, bonds=(1, 1, 1, 1)), "chains of operators": container.Chains(op, 3, "operator"), "blocks": pairs, "complex blocks": blocks.scale(pairs, 1, 1)}


def test_round_trips(spark, tmp_path):
    for name, x in objects(spark).items():
        path = f"file://{tmp_path}/{name.replace(' ', '-')}"
        container.save(x, path)
        got = container.load(spark, path)
        assert type(got) is type(x) and rows(got.df) == rows(x.df) and got.df.dtypes == x.df.dtypes
        for field in ("shape", "legs", "flux", "kind", "n", "bonds"):
            assert getattr(got, field, None) == getattr(x, field, None)
        with pytest.raises(PySparkException):
            container.save(x, path)


@pytest.mark.parametrize(("name", "change", "says"), [
    ("dense", {"magic": "other"}, "not a container"), ("dense", {"version": 2}, "version"), ("dense", {"element": "string"}, "type"), ("dense", {"element": "bigint"}, "aren't bigint"),
    ("dense", {"kind": "cube"}, "no container"), ("dense", {"kind": "complex"}, "aren't double"), ("dense", {"shape": [2]}, "columns"), ("dense", {"shape": [2, -1]}, "extent"), ("dense", {"shape": None}, "extent"), ("dense", {"shape": [2, True]}, "extent"),
    ("complex", {"element": "complex bigint"}, "aren't complex"), ("complex", {"kind": "dense"}, "aren't complex"), ("chains of states", {"sites": 0}, "sites"), ("chains of states", {"bonds": [1, 1]}, "bonds"), ("chains of states", {"kind": "chains of operators"}, "columns"),
    ("blocks", {"sector": "u2"}, "sector kind"), ("blocks", {"sector": "u1"}, "no sector"), ("blocks", {"flux": 0}, "no pair"), ("blocks", {"flux": [0, 2]}, "no sector"), ("blocks", {"legs": [{"direction": 0}]}, "direction"), ("blocks", {"legs": [{}]}, "legs"),
    ("blocks", {"legs": [{"direction": 1, "sectors": [[1, 0], [0, 0]], "dims": [1, 1]}]}, "ascend"), ("blocks", {"legs": [{"direction": 1, "sectors": [[0, 0]], "dims": [0]}]}, "size"), ("blocks", {"legs": [{"direction": 1, "sectors": [[0, 0]], "dims": [1]}]}, "columns"),
])
def test_manifests_are_checked(spark, tmp_path, name, change, says):
    path = f"file://{tmp_path}/x"
    container.save(objects(spark)[name], path)
    about = json.loads(spark.read.parquet(f"{path}/manifest").first()["manifest"]) | change
    spark.createDataFrame([(json.dumps(about),)], "manifest string").write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(ContainerError, match=says):
        container.load(spark, path)


def test_elements_are_checked(spark, tmp_path):
    made = itertools.count()

    def kept(x, df):
        path = f"file://{tmp_path}/{next(made)}"
        container.save(x, path)
        df.write.mode("overwrite").parquet(f"{path}/elements")
        return container.load(spark, path).df

    for name, x in objects(spark).items():
        first = x.df.columns[0] if not name.startswith("chains") else "site"
        for bad, says in ((x.df.unionByName(x.df.limit(1)), "repeated"), (x.df.withColumn(first, F.lit(99).cast(x.df.schema[first].dataType)).limit(1), "outside"), (x.df.withColumn(x.df.columns[-1], F.lit(None).cast(x.df.schema[x.df.columns[-1]].dataType)), "null")):
            with pytest.raises(PySparkException, match=says):
                kept(x, bad).collect()
    state = objects(spark)["chains of states"]
    with pytest.raises(PySparkException, match="outside"):
        kept(state, state.df.withColumn("r", F.lit(1).cast("bigint"))).collect()
    with pytest.raises(ContainerError, match="no manifest"):
        container.load(spark, f"file://{tmp_path}/none")
    spark.createDataFrame([("{",)], "manifest string").write.parquet(f"file://{tmp_path}/broken/manifest")
    with pytest.raises(ContainerError, match="can't be read"):
        container.load(spark, f"file://{tmp_path}/broken")


# sectors


def test_laws_of_sectors(spark):
    for kind, values in (("u1", (0, 1, -3)), ("z2", (0, 1)), (PAIR, ((1, 0), (-2, 1))), (NESTED, (((1, 0), 2), ((-1, 1), 3)))):
        one = sectors.identity(kind)
        for a, b in itertools.product(values, repeat=2):
            assert sectors.fused(kind, a, one) == a and sectors.fused(kind, a, sectors.dual_of(kind, a)) == one and sectors.fused(kind, a, b) == sectors.fused(kind, b, a)
            got = spark.range(1).select(sectors.fuse(kind, [sectors.literal(kind, a), sectors.dual(kind, sectors.literal(kind, b))]).alias("q")).first()["q"]
            assert sectors.value(got) == sectors.fused(kind, a, sectors.dual_of(kind, b))
    for kind, bad in (("z2", 2), ("u1", 1 << 31), (PAIR, (0, 2)), (PAIR, 1), ("u1", True)):
        with pytest.raises(BlockError):
            sectors.valid(kind, bad)
    with pytest.raises(BlockError):
        sectors.fused("u1", sectors.HIGH, 1)
    with pytest.raises(BlockError):
        sectors.dual_of("u1", sectors.LOW)
    with pytest.raises(BlockError):
        sectors.known("u2")
    with pytest.raises(PySparkException, match="no sector"):
        spark.range(1).select(sectors.fuse("u1", [F.lit(sectors.HIGH), F.lit(1)])).collect()
    with pytest.raises(BlockError):
        blocks.zeros(spark, (blocks.Leg(1, (0, 2), (1, 1)), blocks.Leg(-1, (0, 2), (1, 1))), 0, "z2")


def dense(t):
    """As one array, whose axes have the blocks side by side."""
    starts = [np.cumsum([0, *leg.dims]) for leg in t.legs]
    out = np.zeros([s[-1] for s in starts], complex)
    for r in t.df.collect():
        out[tuple(s[r[f"b{k}"]] + r[f"i{k}"] for k, s in enumerate(starts))] = complex(r["re"], r["im"]) if "re" in t.values else r["v"]
    return out


def test_tensors_of_pairs(spark):
    t = blocks.random(spark, LEGS, 3, 0, PAIR)
    allowed = {b for b in itertools.product(range(3), range(2), range(4)) for q in [sectors.fused(PAIR, LEGS[0].sectors[b[0]], LEGS[1].sectors[b[1]])] if q == LEGS[2].sectors[b[2]]}
    assert {tuple(r) for r in t.df.select("b0", "b1", "b2").distinct().collect()} == allowed
    a = dense(t)
    both = blocks.contract(t, blocks.dagger(t), [1, 2], [1, 2])
    assert np.allclose(dense(both), np.einsum("abc,dbc->ad", a, a)) and both.flux == (0, 0)
    assert math.isclose(blocks.contract(t, blocks.dagger(t), [0, 1, 2], [0, 1, 2]).df.first()["v"], (abs(a) ** 2).sum())
    u, s, v = blocks.svd(t, 2)
    assert np.allclose(dense(blocks.contract(blocks.diagonal_scale(u, 2, s), v, [2], [0])), a)
    assert blocks.fuse_legs(t, 0, 2).df.count() == t.df.count()
    assert np.allclose(dense(blocks.trace(both, 0, 1)), np.einsum("abc,abc->", a, a))


def test_nested_pairs_and_flux(spark):
    legs = blocks.Leg(1, (((0, 0), 0), ((1, 1), 2)), (1, 2)), blocks.Leg(-1, (((0, 0), 0), ((1, 1), 2)), (1, 2))
    assert blocks.zeros(spark, legs, 0, NESTED).df.count() == 5
    assert blocks.zeros(spark, legs, ((1, 1), 2), NESTED).df.count() == 2
    with pytest.raises(BlockError):
        blocks.zeros(spark, legs, ((1, 2), 2), NESTED)


def test_complex_blocks(spark):
    legs = blocks.Leg(1, (0, 1), (2, 1)), blocks.Leg(-1, (0, 1, 2), (1, 2, 1))
    one = blocks.random(spark, legs, 5, 1)
    t = blocks.BlockTensor(one.df.select(*one.coords, F.col("v").alias("re"), (F.col("v") * F.col("v") - 1).alias("im")), legs, 1)
    t = blocks.from_elements(t.df, legs, -1, drop=True) if not t.df.count() else t
    a = dense(t)
    assert rows(blocks.dagger(blocks.dagger(t)).df) == rows(t.df) and blocks.dagger(t).flux == -1 and blocks.dagger(t).legs[0].direction == -1
    assert np.allclose(dense(blocks.contract(t, blocks.dagger(t), [1], [1])), a @ a.conj().T)
    assert np.allclose(dense(blocks.contract(one, blocks.dagger(t), [1], [1])), dense(one) @ a.conj().T)
    assert np.allclose(dense(blocks.scale(t, 2, -1)), (2 - 1j) * a)


def test_full_contraction_of_a_foreign_flux(spark):
    legs = blocks.Leg(1, (0, 1), (2, 1)), blocks.Leg(-1, (0, 1), (2, 1))
    a, b = blocks.random(spark, legs, 1, 0), blocks.random(spark, tuple(leg.dual() for leg in legs), 2, 1)
    assert blocks.contract(a, b, [0, 1], [0, 1]).df.count() == 0
    assert blocks.contract(a, blocks.dagger(a), [0, 1], [0, 1]).df.count() == 1
    with pytest.raises(BlockError, match="meet"):
        blocks.contract(a, a, [0], [0])
    with pytest.raises(PySparkException, match="outside the allowed"):
        blocks.from_elements(a.df.withColumn("b1", 1 - F.col("b1")), legs).df.collect()
    assert blocks.from_elements(a.df.withColumn("b1", 1 - F.col("b1")), legs, drop=True).df.count() == 0


def test_large_blocks_are_spread_out(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SPREAD", 7)
    legs = blocks.Leg(1, (0, 1), (10, 3)), blocks.Leg(-1, (0, 1), (9, 2))
    t = blocks.from_block_fn(spark, legs, lambda b0, b1, i0, i1: b0 * 1000 + i0 * 10 + i1)
    got = {tuple(r)[:4]: r["v"] for r in t.df.collect()}
    assert got == {(b, b, i, j): b * 1000 + i * 10 + j for b, m, n in ((0, 10, 9), (1, 3, 2)) for i in range(m) for j in range(n)}


# the rest


def test_operators_of_a_site(spark):
    def of(family, name):
        m = np.zeros((2, 2), complex)
        for r in site_ops.site_operator(spark, family, name).collect():
            m[r["bra"], r["ket"]] = complex(r["re"], r["im"])
        return m

    q = {n: of("qubit", n) for n in site_ops.OPERATORS["qubit"]}
    assert np.allclose(q["t"] @ q["t"], q["s"]) and np.allclose(q["s"] @ q["s"], q["z"]) and np.allclose(q["proj0"] + q["proj1"], q["id"]) and np.allclose(q["proj0"] - q["proj1"], q["z"])
    assert np.allclose(q["h"] @ q["x"] @ q["h"], q["z"]) and np.allclose(q["x"] @ q["y"], 1j * q["z"])
    s = {n: of("spin_half", n) for n in site_ops.OPERATORS["spin_half"]}
    assert np.allclose(s["sp"] @ s["sm"] - s["sm"] @ s["sp"], 2 * s["sz"]) and np.allclose(s["sp"].T, s["sm"]) and np.allclose(s["id"], np.eye(2))


def test_normalized_gives_the_norm(spark):
    t, n = elementwise.normalized(from_values(spark, [3.0, 4.0], (2,)))
    assert n == 5 and rows(t.df) == [(0, 0.6), (1, 0.8)]
    with pytest.raises(TensorError):
        elementwise.normalized(from_values(spark, [0.0], (1,)))


def test_sketches_of_chains(spark):
    rng = np.random.default_rng(3)
    sites = [[rng.normal(size=s) for s in ((1, 2, 2), (2, 2, 3), (3, 2, 1))] for _ in range(3)]
    elements = [(c, k, l, p, r, float(s[l, p, r])) for c, own in enumerate(sites) for k, s in enumerate(own) for l, p, r in np.ndindex(*s.shape)]
    m = spark.createDataFrame(elements, "chain bigint, site bigint, l bigint, p bigint, r bigint, v double")
    got = chains.sketches(m, 3, 5, 9)
    grid = spark.range(3 * 2 * 5).select((F.col("id") % 3).alias("k"), (F.floor(F.col("id") / 3) % 2).alias("p"), F.floor(F.col("id") / 6).alias("c"))
    drawn = np.zeros((3, 2, 5))
    for k in range(3):
        u = [chains.uniform(9, k, j, F.col("p"), F.col("c")) for j in (0, 1)]
        for r in grid.where(F.col("k") == k).select("p", "c", (F.sqrt(-2.0 * F.log(u[0])) * F.cos(2 * math.pi * u[1])).alias("g")).collect():
            drawn[k, r["p"], r["c"]] = r["g"]
    want = {}
    for c, own in enumerate(sites):
        env = np.ones((1, 5))
        for k in (2, 1, 0):
            env = np.einsum("lpr,rc,pc->lc", own[k], env, drawn[k])
            want |= {(c, k, l, x): env[l, x] for l, x in np.ndindex(*env.shape)}
    rows_ = {(r["chain"], r["site"], r["l"], r["c"]): r["v"] for r in got.collect()}
    assert rows_.keys() == want.keys() and all(abs(rows_[k] - want[k]) < 1e-9 for k in want)
    more = {tuple(r)[:4]: r["v"] for r in chains.sketches(m, 3, 7, 9).where("c < 5").collect()}
    assert all(abs(more[k] - want[k]) < 1e-9 for k in want)  # columns added change none there is
    exact = {r["chain"]: r["norm"] for r in chains.norm(m, 3).collect()}
    bound = math.sqrt((3**3 - 1) / 2000)
    assert all(abs(r["norm"] ** 2 / exact[r["chain"]] ** 2 - 1) < 3 * bound for r in chains.estimated_norms(m, 3, 2000).collect())
    assert [r["norm"] for r in chains.estimated_norms(m.where("site <> 1"), 3, 2).collect()] == [0.0] * 3
    with pytest.raises(TensorError):
        chains.sketches(m, 3, 0)
