"""Sums and products beyond what bigint or double holds, matrices dealt whole, tiles and bases at size."""

import os

import numpy as np
import pytest

from sparktn.operators import contract, elementwise, factorize, krylov, sketch, tiles
from sparktn.plans import queries
from sparktn.sources.storage import stored
from sparktn.tensor import Tensor, from_values

DATA = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def values(t):
    return {tuple(r[:-1]): r[-1] for r in t.df.select(*t.axes, "v").collect()}


def set_for(spark, **conf):
    """Settings, and a function that brings the former back."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    return lambda: [spark.conf.unset(k) if v is None else spark.conf.set(k, v) for k, v in before.items()]


def test_three_large_factors_are_exact(spark, monkeypatch):
    """F1: sums of 2,100,000 in all places, as at 0.1 GB: a product of three and 42 times as much is beyond bigint."""
    big = 2_100_000
    full = from_values(spark, [big] * 42, (7, 3, 2))
    monkeypatch.setattr(queries, "t3", lambda s, d: full)
    rows = queries.einsum_chain3(spark, "").collect()
    assert len(rows) == 42 and all(int(r["v"]) == big**3 * 42 for r in rows)
    monkeypatch.setattr(queries, "t3", lambda s, d: from_values(spark, [3] * 42, (7, 3, 2)))
    df = queries.einsum_chain3(spark, "")
    assert df.schema["v"].dataType.simpleString() == "bigint" and {r["v"] for r in df.collect()} == {27 * 42}


def test_matrices_stay_whole_where_joins_are_dealt_by_id(spark):
    """a join by id on either side of a union counted as dealing its rows, whose sides were then put together apart."""
    back = set_for(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
                   spark__sql__adaptive__coalescePartitions__parallelismFirst="false", spark__sql__adaptive__advisoryPartitionSizeInBytes="40KB",
                   spark__sql__adaptive__coalescePartitions__minPartitionSize="1KB", spark__sql__shuffle__partitions="16")
    try:
        one = spark.range(4000).select("id")
        cells = one.selectExpr("id", "explode(sequence(0l, 3l)) as i").selectExpr("id", "i", "explode(sequence(0l, 3l)) as j")
        a = cells.selectExpr("id", "i", "j", "case when i = j then 100.0d else double((id + i * j) % 7) end as v").groupBy("id", "i", "j").agg({"v": "sum"}).withColumnRenamed("sum(v)", "v")
        b = a.selectExpr("id", "i", "v * (j + 1) as v").groupBy("id", "i").agg({"v": "sum"}).selectExpr("id", "i", "0l as j", "`sum(v)` as v")
        rows = factorize.solve(a, b, 4, 1).collect()
        assert len(rows) == 16000 and all(round(r["v"]) == r["i"] + 1 for r in rows)
    finally:
        back()


def test_sums_of_whole_numbers_are_whole(spark):
    """values whose sums and products are odd and above 2^53."""
    big = (1 << 27) + 1
    a, b = from_values(spark, [big, 1], (2,)), from_values(spark, [0, 0], (2,))
    assert contract.inner(a, elementwise.add_all([a, b])).first()["v"] == big * big + 1


def test_products_with_listed_values_are_exact(spark):
    """a list of whole numbers keeps whole numbers whole."""
    big = (1 << 27) + 1
    rows = Tensor(spark.createDataFrame([(0, 0, big)], "i0 bigint, i1 bigint, v bigint"), (1, 1))
    one = contract.einsum("ij,j->i", rows, from_values(spark, [1], (1,)))
    assert values(contract.tensordot(one, one, [], [])) == {(0, 0): big * big}


@has_data
def test_exponential_has_its_square(spark):
    """the term of second order is there, of all lines."""
    rows = queries.expm_nilpotent(spark, DATA)
    b = {(r["id"], r["i"], r["j"]): int(r["v"]) for r in queries.batch(spark, DATA).collect()}
    want = {}
    for (k, i, j), v in b.items():
        for (m, p, q), w in b.items():
            if k == m and j == p:
                want[k, i, q] = want.get((k, i, q), 0) + v * w
    got = {(r["id"], r["i"], r["j"] - 14): r["v"] for r in rows.where("i < 7 and j >= 14").collect()}
    assert want and got == want


def test_sketch_holds_many_columns_in_a_row(spark):
    """what is joined and summed has a row for each WIDE columns, not for each column; the columns are those asked for."""
    from sparktn.operators import chains

    m = spark.createDataFrame([(0, 0, 0, 0, 0, 1), (0, 1, 0, 0, 0, 1)], "chain bigint, site bigint, l bigint, p bigint, r bigint, v bigint")
    made, keep = [], chains.stored

    def counted(df, name, by=None):
        out = keep(df, name, by)
        if name == "sketch":
            made.append(out.count())
        return out

    chains.stored = counted
    try:
        rows = chains.sketches(m, 2, 40).where("site = 0").collect()
    finally:
        chains.stored = keep
    assert made == [3] and sorted(r["c"] for r in rows) == list(range(40))


def test_a_step_of_the_basis_is_one_join(spark, monkeypatch):
    """the basis has a row a place and a step writes one table, however many vectors there are; values are numpy's."""
    a = np.diag(np.arange(1.0, 13)) + np.diag(np.ones(11), 1) + np.diag(np.ones(11), -1)
    elements = stored(spark.createDataFrame([(i, j, float(a[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(a)))], "i bigint, j bigint, v double"), "a")
    sizes = []

    def counted(df, name):
        sizes.append((out := stored(df, name)).count())
        return out

    monkeypatch.setattr(krylov, "stored", counted)
    value, residual, x = krylov.lowest(krylov.matrix(elements), krylov.random_vector(spark, 12, 3), steps=9, basis_size=5, keep=2, tol=0.0)
    assert sizes == [12] * 10
    x = np.array([r["v"] for r in x.orderBy("i").collect()])
    assert abs(np.linalg.norm(x) - 1) < 1e-10 and abs(np.linalg.norm(a @ x - value * x) - residual) < 1e-8


def test_tiles_hold_their_elements_only(spark):
    """F8: a tile of few elements is shuffled as these, not as a block of zeros; sums are those of the elements."""
    n = 4 * 64 * 256
    a = {(37 * k % 128, 9973 * k % 512): k % 9 + 1 for k in range(40)}
    b = {(61 * k % 512, k % 8): k % 7 + 1 for k in range(60)}
    t, u = (Tensor(spark.createDataFrame([(*k, v) for k, v in x.items()], "i0 bigint, i1 bigint, v bigint"), s) for x, s in ((a, (128, 512)), (b, (512, 8))))
    left = tiles.tiled(t, (64, 256))
    held = left.df.select("at", "x").collect()
    assert sum(len(r["x"]) for r in held) == len(a) < n and all(len(r["at"]) == len(r["x"]) for r in held)
    want = {}
    for (i, j), x in a.items():
        for (m, k), y in b.items():
            if m == j:
                want[i, k] = want.get((i, k), 0) + x * y
    assert values(tiles.untiled(tiles.einsum("ij,jk->ik", left, tiles.tiled(u, (256, 8))))) == want and want


def shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    jvm = spark.sparkContext._jvm
    numbers = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark._jsparkSession.sparkContext().statusStore().stageList(None, False, False, numbers, jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def sparse(rng, rows, columns, each):
    """Elements of a matrix with `each` in every column, and 300 more in the column 7, which no part of 100 holds."""
    at = {(int(i), j) for j in range(columns) for i in rng.choice(rows, each, replace=False)} | {(i, 7) for i in range(300)}
    return [(i, j, float(rng.integers(1, 50))) for i, j in sorted(at)]


def test_products_of_a_sketch_stay_in_their_part(spark):
    """the elements are moved twice at most (summed, dealt), and no step moves a row of sums for each element."""
    rows = sparse(np.random.default_rng(1), 500, 2000, 6)
    df = spark.createDataFrame(rows, "i bigint, j bigint, v double").repartition(8)
    back = set_for(spark, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="16", spark__sql__files__maxPartitionBytes="64KB")
    try:
        before = shuffled_rows(spark)
        sketch.sparse_svd(df, 2, more=2, powers=3)
        assert shuffled_rows(spark) - before < 5 * len(rows)
    finally:
        back()


def test_a_column_in_several_parts_is_summed(spark, monkeypatch):
    """parts of 100 elements, a column of more than that, labels that are no numbers or null; values are numpy's."""
    monkeypatch.setattr(sketch, "PART", 100)
    rows = sparse(np.random.default_rng(2), 310, 40, 5)
    a = np.zeros((310, 40))
    for i, j, v in rows:
        a[i, j] = v
    label = lambda k: None if k == 3 else f"c{k:03}"
    df = spark.createDataFrame([(i, label(j), v) for i, j, v in rows], "i bigint, j string, v double")
    u, s, w = sketch.sparse_svd(df, 40, more=0, powers=1)
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False)[: len(s)]) and len(s) == 40
    left, right = {r["i"]: r["u"] for r in u.collect()}, {r["j"]: r["w"] for r in w.collect()}
    assert len(right) == 40 and len(left) == len({i for i, _, _ in rows})
    assert all(abs(np.dot(np.array(left[i]) * s, right[label(j)]) - v) < 1e-8 for i, j, v in rows)
