import math

import numpy as np
import pytest

from sparktn.errors import ContractionError, FactorizationError, TensorError
from sparktn.operators import blocks, contract, elementwise, factorize, krylov, structural
from sparktn.sources.tables import load, save
from sparktn.tensor import eye, from_values, ones, random, zeros


def dense(t):
    out = np.zeros(t.shape)
    for r in t.df.collect():
        out[tuple(r[a] for a in t.axes)] += r["v"]
    return out


@pytest.fixture(scope="module")
def cube(spark):
    return from_values(spark, list(range(24)), (2, 3, 4))


A = np.arange(24.0).reshape(2, 3, 4)


def test_constructors(spark):
    assert (dense(ones(spark, (2, 3))) == 1).all() and (dense(zeros(spark, ())) == 0).all()
    assert (dense(eye(spark, 3)) == np.eye(3)).all()
    assert (dense(random(spark, (4, 4), 5)) == dense(random(spark, (4, 4), 5))).all()
    with pytest.raises(TensorError):
        from_values(spark, [1], (2,))


def test_structure(cube):
    assert (dense(structural.permute(cube, [2, 0, 1])) == A.transpose(2, 0, 1)).all()
    assert (dense(structural.reshape(cube, (4, 6))) == A.reshape(4, 6)).all()
    assert (dense(structural.reshape(cube, (4, 6), "F")) == A.reshape(4, 6, order="F")).all()
    assert (dense(structural.slice_ranges(cube, [(0, 2), (1, 3), (2, 2)])) == A[:, 1:3, 2:2]).all()
    assert (dense(structural.expand(cube, [(1, 0), (0, 0), (0, 2)])) == np.pad(A, [(1, 0), (0, 0), (0, 2)])).all()
    for bad in (lambda: structural.permute(cube, [0, 0, 1]), lambda: structural.reshape(cube, (5, 5)), lambda: structural.get(cube, (2, 0, 0)), lambda: structural.diag(cube)):
        with pytest.raises(TensorError):
            bad()


@pytest.mark.parametrize("notation", ["abc,abd->cd", "abc,dbc->ad", "abc,abc->abc", "abc,abd->acd"])
def test_einsum(cube, spark, notation):
    other = cube
    if "d" in notation:
        other = from_values(spark, list(range(24)), {"abc,abd->cd": (2, 3, 4), "abc,dbc->ad": (2, 3, 4), "abc,abd->acd": (2, 3, 4)}[notation])
    assert np.allclose(dense(contract.einsum(notation, cube, other)), np.einsum(notation, A, A))


def test_einsum_rejects(cube):
    for notation in ("ab->a", "abc->ab", "abc,abd->e", "abc,a1d->c", "aab,abc->c"):
        with pytest.raises(ContractionError):
            contract.einsum(notation, *[cube] * (notation.count(",") + 1))
    with pytest.raises(ContractionError):
        contract.trace(cube, [(0, 1)])


def test_norm(spark):
    of = lambda *v: contract.norm(from_values(spark, list(v), (len(v),)))
    assert of(3, 4) == 5 and of(0, 0) == 0
    assert math.isclose(of(1e200, 1e200), math.sqrt(2) * 1e200)
    assert of(math.inf, 1) == math.inf and math.isnan(of(math.inf, math.nan))
    with pytest.raises(TensorError):
        elementwise.normalize(zeros(spark, (2,)))


def test_factors(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3, 4, 5))
    m = factorize.matrices(from_values(spark, a.ravel().tolist(), (3, 4, 5)), 1, 1)
    for f, parts in ((factorize.svd, ("u", "vt", "s")), (factorize.qr, ("q", "r")), (factorize.lq, ("l", "q"))):
        got = np.zeros_like(a)
        for r in factorize.product(f(m, 4, 5), *parts).collect():
            got[r["id"], r["i"], r["j"]] = r["v"]
        assert np.allclose(got, a)
    with pytest.raises(FactorizationError):
        factorize.eigh(m, 4, 5)
    with pytest.raises(FactorizationError):
        factorize.truncated(m, chi_max=0)


def test_expm():
    a = np.array([[0.0, 3.0], [-3.0, 0.0]])
    assert np.allclose(factorize.exponential(a), [[math.cos(3), math.sin(3)], [-math.sin(3), math.cos(3)]])
    assert np.allclose(factorize.exponential(np.diag([20.0, 1.0])), np.diag(np.exp([20.0, 1.0])))


def test_truncation_target(spark):
    s = spark.createDataFrame([(0, q, k, v) for q, k, v in ((0, 0, 3.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 0.5))], "id int, sector int, k int, s double")
    kept = lambda **b: sorted(r["s"] for r in factorize.truncated(s, **b).where("kept").collect())
    assert kept(target=0.5) == [1.0, 2.0, 3.0] and kept(target=0.49) == [0.5, 1.0, 2.0, 3.0]
    assert kept(target=100.0) == [3.0] and kept(chi_max=2) == [2.0, 3.0]


def test_blocks_match_dense(spark):
    legs = (blocks.Leg(1, (0, 1), (2, 1)), blocks.Leg(1, (0, 1), (3, 2)), blocks.Leg(-1, (0, 1), (2, 3)))
    found = blocks.allowed_blocks(spark, legs).collect()
    assert [(r["b0"], r["b1"], r["b2"]) for r in found] == [(0, 0, 0), (0, 1, 1), (1, 0, 1)]
    assert [r["offset"] for r in found] == [0, 12, 24]
    with pytest.raises(blocks.BlockError):
        blocks.leg_table(spark, blocks.Leg(1, (1, 0), (1, 1)), 0)


def test_lanczos(spark):
    a = np.random.default_rng(1).normal(size=(6, 6))
    a = a + a.T
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(6)], "i bigint, j bigint, v double")
    value, done = krylov.lanczos_smallest(df, 6, 6)
    assert abs(value - np.linalg.eigvalsh(a)[0]) < 1e-7


def test_files(cube, spark, tmp_path):
    save(cube, f"file://{tmp_path}/t")
    assert (dense(load(spark, f"file://{tmp_path}/t")) == A).all()
    spark.createDataFrame([([1, 1, 1],)], "shape array<bigint>").write.mode("overwrite").parquet(f"file://{tmp_path}/t/shape")
    with pytest.raises(Exception, match="outside the shape"):
        load(spark, f"file://{tmp_path}/t").df.collect()
