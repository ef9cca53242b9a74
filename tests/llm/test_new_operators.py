"""Whitening, the filter audit and the mix against brute force, on awkward tables."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktn.llm import filter_audit, mixing, whitening

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def sql_rows(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toPandas().astype({"doc_id": "Int64"}))
    got = c.sql(sql)
    order = [got.columns.index(x) for x in sorted(got.columns)]
    return Counter(tuple(r[k] for k in order) for r in got.fetchall())


# whitening


def brute_whitening(vectors, components=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    y = np.array([[float(n * a - s) / n for a, s in zip(row, total)] for row in x])
    v = y.T @ y / n
    w, u = np.linalg.eigh(v)
    w, u = w[::-1], u[:, ::-1]
    k = min(components, int((w > len(v) * 2.3e-16 * np.abs(v).sum(axis=1).max()).sum()))
    deviation = [sum(int(n * a - s) ** 2 for a, s in zip(row, total)) for row in x]
    return n, deviation, (y @ u[:, :k]) / np.sqrt(w[:k]), w[:k] / np.trace(v)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 12)) * np.arange(1, 13)).astype(np.float32).tolist()
    bad = [None, [float("nan")] * 12, [None] + [1.0] * 11, [float("inf")] + [0.0] * 11, [1.0] * 3, []]
    df = spark.createDataFrame([(k % 290, v, 1, "x") for k, v in enumerate(vectors + bad)], "vec_id bigint, embedding array<float>, component int, key string").repartition(5)
    rows = whitening.whitened(df).collect()
    n, deviation, want, explained = brute_whitening(vectors)
    assert len(rows) == 300 * 12 and {r["n"] for r in rows} == {n} and all(r["identity_error"] < 1e-9 for r in rows)
    got = defaultdict(list)
    for r in rows:
        got[r["vec_id"], r["deviation"]].append((r["component"], r["whitened"], r["explained"]))
    signs = {}
    for k, v in enumerate(vectors):
        for c, w, e in got[k % 290, deviation[k]]:
            assert abs(e - explained[c - 1]) < 1e-9
            if abs(want[k, c - 1]) > 0.1:
                signs.setdefault(c, w / want[k, c - 1])
                assert abs(w / want[k, c - 1] - signs[c]) < 1e-8 and abs(abs(signs[c]) - 1) < 1e-8


def test_whitening_of_odd_tables(spark):
    kind = "vec_id bigint, embedding array<float>"
    of = lambda rows: whitening.whitened(spark.createDataFrame(rows, kind))
    assert of([]).count() == 0 and of([(1, None)]).count() == 0 and of([(1, [1.0, 2.0])]).count() == 0
    assert of([(k, [1.0, 2.0]) for k in range(9)]).count() == 0
    assert of([(None, [float(k), 2.0 * k]) for k in range(9)]).count() == 9  # one direction only
    far = of([(k, [1e30 * (k % 2), float(k)]) for k in range(6)]).collect()
    assert len(far) == 6 * len({r["component"] for r in far}) and all(r["deviation"] is None for r in far)


def test_eigenvalues_by_slicing():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    for values in (np.r_[[4.0] * 7, [2.0] * 20, rng.uniform(0, 1, 13)], 10.0 ** -np.arange(40), 1 + 1e-10 * np.arange(40), np.r_[1.0, np.zeros(39)]):
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        found, vectors = whitening.leading(v, 32)
        want = np.sort(values)[::-1][: len(found)]
        assert len(found) == min(32, (values > 1e-13 * values.max()).sum()) or values.min() < 1e-13
        assert np.abs(found - want).max() < 1e-12 * want[0] and np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
        assert np.abs(v @ vectors - vectors * found).max() < 1e-12 * want[0] and whitening.certified(v, found)
    for shift in (-0.5, 0.3, 2.5):
        a = rng.normal(size=(30, 30))
        a = a + a.T
        np.fill_diagonal(a, 0)  # pivots of two rows are needed
        assert whitening.inertia(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    assert not whitening.certified(np.diag([3.0, 2.0, 1.0]), np.array([3.0, 1.0]))


def test_products_are_exact():
    rng = np.random.default_rng(6)
    for top in (1 << 10, 1 << 40):
        y = rng.integers(-top, top, size=(2500, 3))
        assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()


# the audit

TEXTS = [
    (1, "a b c " * 80, "s"), (2, "a b c " * 80, "s"), (3, " ".join(f"w{k}" for k in range(250)), "s"), (4, None, "s"), (5, "", None), (6, "", "t"), (7, "ABC " + " ".join(f"v{k}" for k in range(220)), None),
    (8, "50 % off $ & more", "t"), (8, "50 % off $ & more", "t"), (None, "a b c " * 80, "t"), (None, None, ""), (9, "\x1c  é \U0001f600 " + " ".join(f"u{k}" for k in range(300)), "t"), (10, "x" * 300_000, "s"), (11, " ".join(f"w{k}" for k in range(250)), "t"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (3, 1, None), (8, 1, 1), (9, None, 1), (None, 1, 1), (99, 1, 1), (11, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, s, 1, "x", 2) for d, t, s in TEXTS], "doc_id bigint, text string, source string, failed int, digest string, n int").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


def brute_audit(texts, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for d, t, s in texts:
        t = t or ""
        words = BLANKS.findall(t)
        own = ("A" if len(words) < 200 else "") + ("B" if 100 * len(set(words)) < 50 * len(words) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else "") + ("D" if re.search(r"[#$%&*|]", t) else "")
        own += "E" if d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in texts) else ""
        fails.append((s or "", own, d in good, d in toxic))
    out, shapley = [], Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order):
                hit = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                shapley[part, name] += len(hit)
                out.append((part, order, step + 1, name, len(left), len(hit), sum(name in f[1] for f in mine) - len(hit), sum(f[1] == name for f in mine), sum(f[2] for f in hit), sum(f[3] for f in hit)))
    return Counter((*r[:3], *r[4:], shapley[r[0], r[3]]) for r in out)


def test_audit_equals_brute_force_and_sql(docs, labels, spark):
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    df = filter_audit.audit(docs, labels)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == brute_audit(TEXTS, LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert sum(r["good_lost"] + r["toxic_lost"] for r in filter_audit.audit(docs, labels.limit(0)).collect()) == 0
    assert rows_of(df) == sql_rows(filter_audit.SQL, documents=docs.select("doc_id", "text", "source"), labels=labels)


def test_popcounts_and_parts(monkeypatch):
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 5, 31, 1000, 4097):
        w = rng.integers(0, 1 << 32, size=n, dtype=np.uint32)
        assert (filter_audit.popcounts(w) == [int((w >> k & 1).sum()) for k in range(32)]).all()
    text = " ".join(f"w{k % 700}" for k in range(5000)).encode() + b"\n\x0b  end"
    whole = filter_audit.word_counts(text)
    monkeypatch.setattr(filter_audit, "PART", 37)
    assert filter_audit.word_counts(text) == whole == (5001, 701) and filter_audit.word_counts(b"x" * 99) == (1, 1) and filter_audit.word_counts(b" " * 99) == (0, 0)


# the mix


def mixed_texts():
    rng = np.random.default_rng(8)
    out = [(k, " ".join(["w"] * int(rng.integers(0, 60))), "big" if k % 3 else f"s{k % 5}") for k in range(400)]
    return [*out, (7, "again", "big"), *[(7, "same  words\there", "big")] * 30, (None, "no id here", None), (None, None, None), (1000, "w " * 5000, "long"), (1001, "", "empty"), (1002, None, "empty"), (1003, "\n\n  ", "s1"), (1004, "one", "tiny"), (1005, "a b\x1cc d", "￿"), (1006, "x", "\U00010000")]


@pytest.mark.parametrize(("block", "shard"), [(16, 8), (2048, 512)])
def test_mix(spark, block, shard):
    texts = mixed_texts()
    docs = spark.createDataFrame([(d, t, s, 5, "k", 3) for d, t, s in texts], "doc_id bigint, text string, source string, size int, place string, copies int").repartition(3)
    df = mixing.mix(docs, block, shard)
    rows = df.collect()
    sizes = Counter((d, len(BLANKS.findall(t or ""))) for d, t, _ in texts)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == sizes
    own = Counter()
    for _, t, s in texts:
        own[s] += len(BLANKS.findall(t or ""))
    order = sorted((s for s in own if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    free, rest = set(order), 1.5 * sum(own.values())
    while True:
        share = rest / sum(weight[s] for s in free)
        above = {s for s in free if share * weight[s] > 2 * own[s]}
        if not above:
            break
        free -= above
        rest -= sum(2 * own[s] for s in above)
    target = {s: share * weight[s] if s in free else 2.0 * own[s] for s in order}
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    taken, seen = Counter(), {}
    for r in rows:
        key = r["source_size"], round(r["target"], 6)
        taken[key] += r["taken"]
        seen[key] = 1
    wanted = Counter()
    for s in order:
        wanted[own[s], round(target[s], 6)] += int(target[s] + 1e-9)
    assert taken == wanted
    assert rows_of(df) == rows_of(mixing.mix(docs.repartition(7), block, shard))
    assert rows_of(df) == sql_rows(mixing.sql(block, shard), documents=docs.select("doc_id", "text", "source"))
    assert mixing.mix(docs.limit(0), block, shard).count() == 0
    assert [r["taken"] for r in mixing.mix(docs.where("source = 'empty'"), block, shard).collect()] == [0, 0]


def test_permutations_and_shards(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(1)).alias("to"))
        back = df.select("id", "to", mixing.permuted(F.col("to"), F.lit(n), F.lit(3), F.lit(1), inverse=True).alias("back")).collect()
        assert sorted(r["to"] for r in back) == list(range(n)) and all(r["id"] == r["back"] for r in back)
    docs = spark.createDataFrame([(k, "w " * 64, f"s{k % 4}") for k in range(400)], "doc_id bigint, text string, source string")
    sources = mixing.sources_of(mixing.documents_of(docs))
    plan = mixing.planned(sources, 16)
    slots = mixing.slots(plan, 16, 100).collect()
    due = {r["place"]: r["q"] for r in plan.collect()}
    assert Counter(r["place"] for r in slots) == due and sorted(r["slot"] for r in slots) == list(range(sum(due.values())))
    assert all(sorted(r["turn"] for r in slots if r["place"] == p) == list(range(q)) for p, q in due.items())
    shares = defaultdict(list)
    for s in range(sum(due.values()) // 100):
        for p, q in due.items():
            shares[p].append(sum(r["place"] == p for r in slots if r["shard"] == s) - 100 * q / sum(due.values()))
    assert all(0 < np.var(x) < 100 for x in shares.values())  # drawn, not dealt out evenly


def test_whole_numbers_are_kept():
    assert whitening.whole(np.array([-0.1, 0.0, 0.5, 1e300])).tolist() == [999_993, 1_000_000, 1_000_032, 1 << 40]
