"""Complex tensors, blocks and their factors, chains with checks, and errors that must not pass silently."""

import math
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparktn.errors import BlockError, TensorError
from sparktn.functions import sectors, site_ops
from sparktn.operators import blocks, chains, complexes, contract, elementwise, factorize, tall
from sparktn.sources.tables import load, load_blocks, save_blocks
from sparktn.tensor import from_values

LEGS = blocks.Leg(1, (0, 1), (2, 1)), blocks.Leg(1, (0, 1), (3, 2)), blocks.Leg(-1, (0, 1), (2, 3))


def complex_of(spark, x):
    return complexes.to_complex(from_values(spark, x.real.ravel().tolist(), x.shape), from_values(spark, x.imag.ravel().tolist(), x.shape))


def dense(t):
    out = np.zeros(t.shape, complex)
    for r in t.df.collect():
        out[tuple(r[a] for a in t.axes)] = complex(r["re"], r["im"])
    return out


def test_complex(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.normal(size=s) + 1j * rng.normal(size=s) for s in ((2, 3), (3, 4)))
    x, y = complex_of(spark, a), complex_of(spark, b)
    assert np.allclose(dense(complexes.contract(x, y, "ij,jk->ik")), a @ b)
    assert np.allclose(dense(complexes.conjugate_transpose(x)), a.conj().T)
    assert np.allclose(dense(complexes.scale(x, 2, -1)), a * (2 - 1j))
    got = complexes.inner(x, x).first()
    assert math.isclose(got["re"], np.vdot(a, a).real) and abs(got["im"]) < 1e-9
    assert math.isclose(contract.norm(complexes.magnitude(x)), np.linalg.norm(a))
    with pytest.raises(TensorError):
        complexes.contract(x, y, "ij,jk->k")
    kept = spark.createDataFrame([("1.5",), ("nan",), ("inf",)], "x string").select(complexes.real_from(F.col("x")).alias("x")).collect()
    assert [r["x"] for r in kept] == [1.5, None, None]


def test_norm_of_extremes(spark):
    of = lambda *v: contract.norm(from_values(spark, list(v), (len(v),)))
    assert math.isclose(of(1e-200, 1e-200), math.sqrt(2) * 1e-200) and math.isclose(of(1e300, 1e-300, 1.0), 1e300)
    assert of(1.7e308, 1.7e308) == math.inf and of() == 0 and math.isclose(of(5e-324), 5e-324)
    assert contract.combine_norms(3, 4) == 5 and math.isnan(contract.combine_norms(math.inf, math.nan))


def test_block_constructors_and_svd(spark):
    t = blocks.random(spark, LEGS, 3)
    blocks_of = {(0, 0, 0): 12, (0, 1, 1): 12, (1, 0, 1): 9}
    found = {tuple(r[f"b{k}"] for k in range(3)): r["n"] for r in t.df.groupBy("b0", "b1", "b2").agg(F.count("*").alias("n")).collect()}
    assert found == blocks_of and blocks.block(t, (1, 0, 1)).count() == 9 and blocks.block(t, (1, 1, 0)).count() == 0
    u, s, v = blocks.svd(t, 2)
    back = blocks.contract(blocks.diagonal_scale(u, 2, s), v, [2], [0])
    key = lambda r: tuple(r[c] for c in t.coords)
    want, got = {key(r): r["v"] for r in t.df.collect()}, {key(r): r["v"] for r in back.df.collect()}
    assert all(abs(got.get(k, 0) - x) < 1e-9 for k, x in want.items()) and all(abs(x) < 1e-9 or k in want for k, x in got.items())
    with pytest.raises(BlockError):
        blocks.square_sectors(t, 2)
    with pytest.raises(PySparkException):
        blocks.diagonal_scale(t, 0, spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "sector int, i bigint, w double")).df.collect()


def test_block_storage_rejects(spark, tmp_path):
    t = blocks.zeros(spark, LEGS)
    save_blocks(t, f"file://{tmp_path}/good")
    got = load_blocks(spark, f"file://{tmp_path}/good")
    assert got.df.count() == 33 and got.legs == t.legs
    wrong = blocks.BlockTensor(t.df.withColumn("b2", F.lit(0)), t.legs)
    save_blocks(wrong, f"file://{tmp_path}/bad")
    with pytest.raises(PySparkException):
        load_blocks(spark, f"file://{tmp_path}/bad").df.collect()
    from_values(spark, [1, 2], (2,)).df.unionByName(from_values(spark, [1], (1,)).df).write.parquet(f"file://{tmp_path}/twice/elements")
    with pytest.raises(PySparkException):
        load(spark, f"file://{tmp_path}/twice")  # no shape was written
    spark.createDataFrame([([2],)], "shape array<bigint>").write.parquet(f"file://{tmp_path}/twice/shape")
    with pytest.raises(PySparkException):
        load(spark, f"file://{tmp_path}/twice").df.collect()


def test_sectors(spark):
    df = spark.createDataFrame([(0, 1), (1, 1)], "a int, b int")
    p, q = sectors.fuse_pairs(("u1", "z2"), [(F.col("a"), F.col("b")), (F.lit(2), F.lit(1))])
    assert [tuple(r) for r in df.select(p, q).collect()] == [(2, 0), (3, 0)]
    with pytest.raises(PySparkException):
        df.select(sectors.checked("z2", F.col("a") + 1)).collect()


def test_tall_svd_and_elementwise(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-50, 50, (300, 5)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "k bigint, x array<double>").repartition(3)
    u, s, v = tall.tall_svd(df, "k", "x", 5)
    left = np.array([r["u"] for r in u.orderBy("k").collect()])
    assert np.allclose(left * s @ v.T, a) and np.allclose(left.T @ left, np.eye(5)) and np.allclose(s, np.linalg.svd(a)[1])
    t = from_values(spark, [1.0, 0.0, 2.0], (3,))
    assert sorted(r["v"] for r in elementwise.map_values(t, lambda x: x * x).df.collect()) == [0, 1, 4] and {r["v"] for r in elementwise.fill(t, 7.0).df.collect()} == {7}


def test_disconnected_operands_come_last(spark):
    a = from_values(spark, [1.0, 2.0, 3.0, 4.0], (2, 2))
    got = contract.einsum("ij,kl,jk->il", a, a, a)
    assert "CartesianProduct" not in got.df._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in got.df._jdf.queryExecution().toString()
    out = np.zeros((2, 2))
    for r in got.df.collect():
        out[r["i0"], r["i1"]] = r["v"]
    x = np.array([[1.0, 2.0], [3.0, 4.0]])
    assert np.allclose(out, x @ x @ x)


def test_chains(spark):
    site = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 0, 1, 0, 2.0)], "chain bigint, l bigint, p bigint, r bigint, v double")
    m = chains.from_sites([site] * 3, [1, 1, 1, 1])
    assert math.isclose(chains.norm(m, 3).first()["norm"], math.sqrt(5) ** 3) and chains.not_finite(m).count() == 0
    assert chains.not_finite(m.withColumn("v", F.lit(math.inf))).count() == 3
    with pytest.raises(TensorError):
        chains.from_sites([])
    with pytest.raises(PySparkException):
        chains.from_sites([site.withColumn("r", F.lit(1).cast("bigint"))], [1, 1]).collect()
    with pytest.raises(PySparkException):
        chains.apply(chains.total_number(spark, 3, 2), m, 1).collect()
    y = site_ops.applied(m.select("chain", "site", "l", "p", "r", F.col("v").alias("re"), F.lit(0.0).alias("im")), site_ops.site_operator(spark, "qubit", "y"))
    assert {(r["p"], r["re"], r["im"]) for r in y.collect()} == {(0, 0.0, -2.0), (1, 0.0, 1.0)}
    with pytest.raises(TensorError):
        site_ops.site_operator(spark, "qubit", "sz")


def test_long_chains_stay_short_plans(spark):
    n = 40
    m = spark.range(n).select(F.lit(1).cast("bigint").alias("chain"), F.col("id").alias("site"), *(F.lit(0).cast("bigint").alias(c) for c in "lpr"), F.lit(1.0).alias("v"))
    began = time.time()
    df = chains.inner(m, m, n)
    plan = df._jdf.queryExecution().toString()
    assert plan.count("Join") < 12 * chains.STORED and df.first()["overlap"] == 1 and time.time() - began < 120
