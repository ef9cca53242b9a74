"""Tiles, tall and sparse factors, Krylov methods, prefix sums and sums of chains against numpy and brute force."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparktn.errors import ContractionError, FactorizationError, TensorError
from sparktn.functions.prefix import prefix_sums
from sparktn.operators import chains, contract, factorize, krylov, sketch, tall, tiles
from sparktn.plans.queries import svd_leading
from sparktn.sources.tables import quantities
from sparktn.tensor import Tensor, from_values

DATA = "/root/testdata/sf0.001"


def of(spark, a):
    return from_values(spark, a.ravel().tolist(), a.shape)


def dense(t):
    out = np.zeros(t.shape)
    for r in t.df.collect():
        out[tuple(r[a] for a in t.axes)] += r["v"]
    return out


def table(spark, a):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(a)], "k bigint, x array<double>").repartition(5)


def arrays(df, key="k", column="q"):
    return np.array([r[column] for r in df.orderBy(key).collect()])


# tiles


@pytest.mark.parametrize(("rule", "shapes", "cuts"), [
    ("ij,jk->ik", [(7, 9), (9, 5)], dict(i=3, j=4, k=2)),
    ("bij,bkj->bik", [(3, 4, 5), (3, 2, 5)], dict(b=2, i=4, j=2, k=1)),
    ("ij,ij->", [(6, 5), (6, 5)], dict(i=4, j=2)),
    ("ijk,kj->i", [(4, 3, 6), (6, 3)], dict(i=3, j=2, k=4)),
    ("ab,bc,cd->ad", [(3, 8), (8, 6), (6, 4)], dict(a=2, b=3, c=4, d=4)),
    ("i,j->ji", [(3,), (4,)], dict(i=2, j=3)),
])
def test_tiles(spark, rule, shapes, cuts):
    rng = np.random.default_rng(4)
    data = [rng.normal(size=s) for s in shapes]
    parts = rule.split("->")[0].split(",")
    operands = [tiles.tiled(of(spark, a), tuple(cuts[c] for c in p)) for a, p in zip(data, parts)]
    got = tiles.einsum(rule, *operands)
    assert np.allclose(dense(tiles.untiled(got)), np.einsum(rule, *data))
    for a, t in zip(data, operands):
        assert (dense(tiles.untiled(t)) == a).all()


def test_tiles_of_many_summed_and_of_none(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 300)), rng.normal(size=(300, 2))
    got = tiles.einsum("ij,jk->ik", tiles.tiled(of(spark, a), (1, 2)), tiles.tiled(of(spark, b), (2, 2)))  # 150 tiles, salted
    assert np.allclose(dense(tiles.untiled(got)), a @ b)
    empty = Tensor(of(spark, a).df.where("v > 99"), a.shape)
    assert tiles.untiled(tiles.einsum("ij,jk->ik", tiles.tiled(empty, (1, 2)), tiles.tiled(of(spark, b), (2, 2)))).df.count() == 0
    twice = Tensor(of(spark, a).df.unionByName(of(spark, a).df), a.shape)
    assert np.allclose(dense(tiles.untiled(tiles.tiled(twice, (2, 7)))), 2 * a)
    with pytest.raises(TensorError):
        tiles.tiled(of(spark, a), (1,))
    with pytest.raises(ContractionError):
        tiles.einsum("ij,jk->ik", tiles.tiled(of(spark, a), (1, 2)), tiles.tiled(of(spark, b), (3, 2)))
    with pytest.raises(ContractionError):
        tiles.einsum("ij,kl->ik", tiles.tiled(of(spark, a), (1, 2)), tiles.tiled(of(spark, b), (3, 2)))


def test_tiles_shuffle_tiles_not_products(spark):
    a = tiles.tiled(Tensor(quantities(spark, DATA, ("l_suppkey", "l_partkey")), (16, 256)), (16, 64))
    got = tiles.einsum("ij,kj->ik", a, a)
    plan = got.df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[t0" not in plan and plan.count("MapInArrow") >= 3
    assert a.df.count() == 4 and got.df.count() == 1


# order of contraction


def test_order_by_cost():
    sizes = dict(a=1000, b=2, c=1000, d=2, e=1000)
    # given: (ab)(bc) is a 1000 x 1000 table; the cheapest starts at the other end
    assert contract.order_by_cost(["ab", "bc", "cd", "d"], "a", sizes)[0] == (2, 3, 4)
    steps = contract.order_by_cost(["ab", "bc", "cd"], "ad", dict(a=10, b=1000, c=5, d=1000))
    assert steps[0] == (0, 1, 3)
    # counts of elements change what is cheap
    many = contract.order_by_cost(["ij", "jk", "kl"], "il", dict.fromkeys("ijkl", 10**6), [10**6, 10**3, 10**3])
    assert many[0] == (1, 2, 3)
    long = contract.order_by_cost([f"{a}{b}" for a, b in zip("abcdefghijkl", "bcdefghijklm")], "am", dict.fromkeys("abcdefghijklm", 3))
    assert len(long) == 11 and len({x for s in long for x in s[:2]}) == 22


def test_cheapest_order_shuffles_fewer_rows(spark):
    rng = np.random.default_rng(6)
    a, b, c, v = rng.normal(size=(60, 2)), rng.normal(size=(2, 60)), rng.normal(size=(60, 2)), rng.normal(size=2)
    tensors = [of(spark, x) for x in (a, b, c, v)]
    assert np.allclose(dense(contract.einsum("ab,bc,cd,d->a", *tensors)), a @ b @ c @ v)
    sizes = dict(a=60, b=2, c=60, d=2)

    def rows(steps):
        """Rows that the joins make, counted."""
        have, n = {k: (p, t.df.select(*(F.col(x).alias(y) for x, y in zip(t.axes, p)))) for k, (p, t) in enumerate(zip(("ab", "bc", "cd", "d"), tensors))}, 0
        for x, y, to in steps:
            (p, left), (q, right) = have.pop(x), have.pop(y)
            joined = left.join(right, [k for k in p if k in q]) if set(p) & set(q) else left.crossJoin(right)
            n += joined.count()
            keep = [k for k in dict.fromkeys(p + q) if k == "a" or any(k in r for r, _ in have.values())]
            have[to] = "".join(keep), joined.select(*keep).distinct()
        return n

    best = contract.order_by_cost(["ab", "bc", "cd", "d"], "a", sizes)
    assert rows(best) < rows([(0, 1, 4), (4, 2, 5), (5, 3, 6)]) / 10


# tall factors


def test_gram_of_real_values(spark):
    assert np.allclose(dense(contract.gram(table(spark, [[0.3, 0.2], [0.4, 0.1]]), "x", 2)), [[0.25, 0.10], [0.10, 0.05]])
    for bad in ([[1.0], [1.0, 2.0]], [[1.0, None]], [None]):
        df = spark.createDataFrame([(x,) for x in bad], "x array<double>")
        with pytest.raises(PySparkException, match="isn't 2 numbers"):
            contract.gram(df, "x", 2).df.collect()


def test_tall_qr(spark, monkeypatch):
    rng = np.random.default_rng(7)
    u, _ = np.linalg.qr(rng.normal(size=(200, 6)))
    v, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    monkeypatch.setattr(tall, "FAN", 2)  # a tree of three levels
    for a in (rng.normal(size=(200, 6)), (u * np.logspace(0, -10, 6)) @ v.T):
        q, r = tall.tall_qr(table(spark, a), "k", "x", 6)
        q = arrays(q)
        assert np.abs(q.T @ q - np.eye(6)).max() < 1e-14 * 20 and np.abs(q @ r - a).max() < 1e-13
        assert (np.diag(r) > 0).all() and np.abs(np.tril(r, -1)).max() < 1e-13
    low, q = tall.wide_lq(table(spark, a), "k", "x", 6)
    assert np.allclose(low @ arrays(q).T, a.T) and np.abs(np.triu(low, 1)).max() < 1e-13
    for bad in (a[:4], np.hstack([a[:, :5], a[:, :1]]), a[:0]):
        with pytest.raises(FactorizationError):
            tall.tall_qr(table(spark, bad) if len(bad) else table(spark, a).where("k < 0"), "k", "x", 6)


def test_tall_svd_keeps_small_values(spark):
    rng = np.random.default_rng(8)
    u, _ = np.linalg.qr(rng.normal(size=(100, 4)))
    a = u * [1.0, 1e-3, 1e-9, 1e-12]
    left, s, v = tall.tall_svd(table(spark, a), "k", "x", 4)
    assert np.allclose(s, [1.0, 1e-3, 1e-9, 1e-12], rtol=1e-3) and np.allclose(arrays(left, column="u") * s @ v.T, a)
    q, _, s = tall.orthonormal(table(spark, np.hstack([a[:, :2], a[:, :2]])), "k", "x", 4)
    assert len(s) == 2 and np.allclose(arrays(q).T @ arrays(q), np.eye(2))


def test_sparse_svd(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(40, 3)) @ np.diag([9.0, 4.0, 1.0]) @ rng.normal(size=(3, 70)) * 1.0
    rows = [(i, j, float(a[i, j]) / 2) for i in range(40) for j in range(70)] * 2  # repeated coordinates add up
    u, s, w = sketch.sparse_svd(spark.createDataFrame(rows, "i bigint, j bigint, v double"), 3, more=4)
    u, w = arrays(u, "i", "u"), arrays(w, "j", "w")
    assert np.allclose(s, np.linalg.svd(a)[1][:3]) and np.allclose(u * s @ w.T, a) and np.allclose(u.T @ u, np.eye(3)) and np.allclose(w.T @ w, np.eye(3))
    with pytest.raises(FactorizationError):
        sketch.sparse_svd(spark.createDataFrame([(0, 0, 0.0)], "i bigint, j bigint, v double"), 1)


def test_leading_values_of_a_table(spark):
    a = np.zeros((400, 4000))
    for r in quantities(spark, DATA, ("l_suppkey", "l_partkey")).collect():
        a[r["i0"], r["i1"]] = r["v"]
    want = np.linalg.svd(a, compute_uv=False)[:5]
    got = [r["v"] for r in svd_leading(spark, DATA).orderBy("k").collect()]
    assert np.allclose(got, want, rtol=1e-3)


def test_matrices_many_at_once(spark, monkeypatch):
    """Stacks that end within a batch, matrices in several parts, and none."""
    monkeypatch.setattr(factorize, "STACK", 50)
    rng = np.random.default_rng(16)
    a = rng.normal(size=(40, 4, 4))
    rows = [(k, i, j, float(a[k, i, j])) for k in range(40) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(rows, "id bigint, i bigint, j bigint, v double").repartition(3)

    def of(parts, name):
        out = np.zeros((40, 4, 4))
        for r in parts.where(F.col("part") == name).collect():
            out[r["id"], r["i"], r["j"]] = r["v"]
        return out

    u, s, vt = (of(factorize.svd(df, 4, 4), p) for p in ("u", "s", "vt"))
    assert np.allclose(u * s[:, :, 0][:, None, :] @ vt, a)
    left, q = (of(factorize.lq(df, 4, 4), p) for p in "lq")
    assert np.allclose(left @ q, a) and np.allclose(of(factorize.inverse(df, 4, 4), "x") @ a, np.eye(4))
    assert np.allclose(a @ of(factorize.solve(df, df, 4, 4), "x"), a) and np.allclose(of(factorize.expm(df, 4, 4), "x")[3], factorize.exponential(a[3]))
    both = df.unionByName(df.select("id", F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    assert np.allclose(of(factorize.expm_symmetric(both, 4, 4), "x"), np.stack([factorize.exponential(x + x.T) for x in a]))
    assert factorize.svd(df.where("id < 0"), 4, 4).count() == 0


# Krylov methods


def elements(spark, a):
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(len(a)) for j in range(len(a)) if a[i, j]], "i bigint, j bigint, v double")


def vector(df, n):
    out = np.zeros(n)
    for r in df.collect():
        out[r["i"]] = r["v"]
    return out


def test_lowest_with_restarts(spark):
    rng = np.random.default_rng(10)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    a = (q * np.r_[-3.0, np.linspace(0, 1, 19)]) @ q.T
    value, residual, x = krylov.lowest(krylov.matrix(elements(spark, a)), krylov.random_vector(spark, 20, 1), steps=16, basis_size=6, keep=3, tol=1e-7)
    x = vector(x, 20)
    assert abs(value + 3) < 1e-9 and residual <= 1e-7 and np.linalg.norm(a @ x - value * x) < 1e-6 and abs(np.linalg.norm(x) - 1) < 1e-9
    with pytest.raises(TensorError):
        krylov.lowest(krylov.matrix(elements(spark, a)), krylov.random_vector(spark, 20).where("i < 0"))


def test_site_sum(spark):
    x, z, one = np.array([[0, 1], [1, 0]]), np.diag([1, -1]), np.eye(2)
    on = lambda *ops: np.kron(np.kron(ops[2], ops[1]), ops[0])  # noqa: E731  site 0 is the lowest bit
    want = 0.5 * on(z, one, one) - 2 * on(one, x, one) + 3 * on(x, one, x) + on(z, z, one) + 0.25 * on(x @ z, one, one)
    op = krylov.site_sum([(0, 1, 0.5), (2, 0, -2), (5, 0, 3), (0, 3, 1), (1, 1, 0.25)])
    v = np.random.default_rng(11).normal(size=8)
    got = op(spark.createDataFrame([(i, float(y)) for i, y in enumerate(v)], "i bigint, v double"))
    assert np.allclose(vector(got, 8), want @ v)


def test_exponential_action(spark):
    rng = np.random.default_rng(12)
    a, b = rng.normal(size=(12, 12)), rng.normal(size=12)
    table_b = spark.createDataFrame([(i, float(y)) for i, y in enumerate(b)], "i bigint, v double")
    want = factorize.exponential(-0.3 * a) @ b
    y, error = krylov.exponential_action(krylov.matrix(elements(spark, a)), table_b, t=-0.3, steps=12, tol=1e-10)
    assert np.abs(vector(y, 12) - want).max() < 1e-8
    y, error = krylov.exponential_action(krylov.matrix(elements(spark, a)), table_b, t=-0.3, steps=4)
    assert np.linalg.norm(vector(y, 12) - want) < 10 * error and error > 0
    assert krylov.exponential_action(krylov.matrix(elements(spark, a)), table_b.where("i < 0"))[0].count() == 0


def test_conjugate_gradients(spark):
    rng = np.random.default_rng(13)
    a = np.diag(np.r_[1e4, np.ones(9)]) + 0.1 * np.eye(10)[rng.permutation(10)]
    a = (a + a.T) / 2
    x = rng.normal(size=10)
    b = spark.createDataFrame([(i, float(y)) for i, y in enumerate(a @ x)], "i bigint, v double")
    diagonal = spark.createDataFrame([(i, float(a[i, i])) for i in range(10)], "i bigint, v double")
    got, steps, residual = krylov.solve(krylov.matrix(elements(spark, a)), b, diagonal, tol=1e-10)
    assert residual <= 1e-10 and steps <= 10 and np.allclose(vector(got, 10), x, atol=1e-6)
    with pytest.raises(TensorError, match="positive"):
        krylov.solve(krylov.matrix(elements(spark, -a)), b)
    assert krylov.solve(krylov.matrix(elements(spark, a)), b.where("i < 0"))[0].count() == 0


# prefix sums and truncation


def test_prefix_sums(spark):
    rng = np.random.default_rng(14)
    rows = [(int(g) if g else None, float(x), k, None if k % 7 == 0 else k) for k, (g, x) in enumerate(zip(rng.integers(0, 4, 300), rng.normal(size=300)))]
    df = spark.createDataFrame(rows, "g int, x double, part int, w int")
    for by in ([], ["g"]):
        got = prefix_sums(df, [F.col("x").desc()], {"n": F.lit(1), "s": F.col("w")}, by=by, parts=7, whole=True).collect()
        assert len(got) == 300
        for r in got:
            before = [o for o in rows if o[1] > r["x"] and (not by or o[0] == r["g"])]
            mine = [o for o in rows if not by or o[0] == r["g"]]
            assert (r["n"], r["s"], r["n_all"], r["s_all"]) == (len(before), sum(o[3] or 0 for o in before), len(mine), sum(o[3] or 0 for o in mine))
    assert prefix_sums(df.where("part < 0"), [F.col("x")], {"n": F.lit(1)}).count() == 0


def test_truncation_without_one_window(spark):
    df = spark.range(1000).select(F.lit(0).alias("id"), (F.col("id") % 3).alias("sector"), F.col("id").alias("k"), F.pow(F.lit(10.0), -F.col("id") / 50).alias("s"))
    got = factorize.truncated(df, target=1e-9)
    ranked = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in x and "unboundedpreceding$(), -1" in x]
    assert all("windowspecdefinition(part" in x or "part#" in x.split("windowspecdefinition(id")[1].split("NULLS")[0] for x in ranked)  # rows by part, parts' sums by id
    s = np.array([10 ** (-k / 50) for k in range(1000)])
    tails = np.sqrt(np.cumsum(s[::-1] ** 2))[::-1]
    rows = {r["k"]: r for r in got.collect()}
    assert all(rows[k]["rank"] == k + 1 and rows[k]["kept"] == (tails[k] > 1e-9) and abs(rows[k]["discarded"] / tails[k] - 1) < 1e-9 for k in range(1000))


# chains


def test_weighted_sum(spark):
    rng = np.random.default_rng(15)
    rows, want = [], {}
    for chain in (1, 2):
        for term in range(3):
            widths = [1, int(rng.integers(1, 4)), int(rng.integers(1, 4)), 1]
            sites = [rng.normal(size=(widths[k], 2, widths[k + 1])) for k in range(3)]
            for k, s in enumerate(sites):
                rows += [(chain, term, k, i, p, j, float(s[i, p, j])) for i, p, j in np.ndindex(*s.shape)]
            want[chain] = want.get(chain, 0) + (term - 0.5) * np.einsum("apb,bqc,crd->pqr", *sites)
    terms = spark.createDataFrame(rows, "chain bigint, term bigint, site bigint, l bigint, p bigint, r bigint, v double")
    weights = spark.createDataFrame([(c, t, t - 0.5) for c in (1, 2) for t in range(3)], "chain bigint, term bigint, weight double")
    got = {c: np.zeros((2, 2, 2)) for c in want}
    for r in chains.amplitudes(chains.weighted_sum(terms, weights, 3), 3).collect():
        got[r["chain"]][r["p0"], r["p1"], r["p2"]] = r["v"]
    assert all(np.allclose(got[c], want[c]) for c in want)
    one = chains.weighted_sum(terms.where("site = 0 and l = 0 and r = 0"), weights, 1).collect()
    assert len(one) == 4
    with pytest.raises(PySparkException, match="bonds of one"):
        chains.weighted_sum(terms.where("site < 2").withColumn("r", F.col("r") + 1), weights, 2).collect()
