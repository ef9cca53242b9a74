"""Near copies of the pipeline by kind of edit, and the survivors of awkward keys."""

import numpy as np
import pytest

from sparktn.llm import simhash

RNG = np.random.default_rng(11)


def text(n):
    return [f"w{i}" for i in RNG.integers(0, 3000, n)]


def jaccard(a, b):
    a, b = (set(simhash.shingle_set(" ".join(x).encode()).tolist()) for x in (a, b))
    return len(a & b) / len(a | b)


def edits(words, kind):
    n = len(words)
    if kind == "appended":
        return words + text(n * 22 // 100)
    if kind == "cut":
        return words[: n * 84 // 100]
    out = list(words)
    for k in RNG.choice(n, n // 50, replace=False):
        out[k] = "changed"
    return out


@pytest.mark.parametrize("kind", ["appended", "cut", "scattered"])
def test_copies_of_a_kind_of_edit_go(spark, kind):
    pairs = [(w, edits(w, kind)) for w in (text(int(n)) for n in RNG.integers(100, 600, 60))]
    assert all(jaccard(*p) >= simhash.SIMILAR for p in pairs)
    rows = [(2 * i + k, " ".join(p[k])) for i, p in enumerate(pairs) for k in (0, 1)]
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {2 * i for i in range(len(pairs))}


def test_less_alike_texts_stay(spark):
    base = text(300)
    rows = [base] + [base[: 300 - 70 - 5 * k] + text(70 + 5 * k) for k in range(8)]
    assert all(jaccard(base, x) < simhash.SIMILAR for x in rows[1:])
    want = {i for i, x in enumerate(rows) if all(jaccard(x, y) < simhash.SIMILAR for y in rows[:i])}
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want == set(range(9))


def test_dense_groups_give_few_pairs():
    sketch = RNG.integers(0, 256, 120).astype(np.uint8)[None].repeat(simhash.DENSE + 500, axis=0)
    rows = np.arange(len(sketch))
    sketch[rows, rows % 120] ^= 1
    a, b = simhash.likely(sketch)
    up = np.arange(len(sketch))
    for x, y in zip(a, b):
        up[up == up[y]] = up[x]
    assert len(set(up.tolist())) == 1 and len(a) <= (1 + simhash.PARTNERS) * len(sketch)


def test_one_survivor_of_each_component_whatever_its_keys(spark):
    a, b, c, d = (" ".join(text(40)) for _ in range(4))
    rows = [(None, a), (None, b), (None, a), (7, c), (7, d), (None, c + " more")]
    got = sorted(simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), key=str)
    assert got == sorted([(None, a), (None, b), (7, c), (7, d)], key=str)


def test_search_of_a_group_holds_few_pairs(monkeypatch):
    """Equal fingerprints that the second one tells apart: all pairs are candidates and none is linked."""
    import tracemalloc

    monkeypatch.setattr(simhash, "PAIRS", 30_000, raising=False)
    others = RNG.integers(0, 1 << 63, 3000).astype(np.uint64)
    tracemalloc.start()
    assert simhash.linked(np.full(3000, 5, np.uint64), others, 7, 2) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6


def test_large_groups_are_dealt_in_parts(spark, monkeypatch):
    """Groups far over what a task compares: many near copies of one text, and many texts that share half their words."""
    monkeypatch.setattr(simhash, "DENSE", 12)
    base, half = text(120), text(60)
    copies = [base[: k % 100] + ["new"] + base[k % 100 :] + [f"tail{k}"] for k in range(90)]
    sharing = [half + text(60) for _ in range(60)]
    pairs = [(w, edits(w, "scattered")) for w in (half + text(140) for _ in range(10))]
    rows = copies + sharing + [x for p in pairs for x in p]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    want = {i for i, x in enumerate(rows) if all(jaccard(x, y) < simhash.SIMILAR for y in rows[:i])}
    assert got == want


def test_large_groups_that_do_not_shrink_are_compared_whole(spark, monkeypatch):
    """A form that many texts fill in: they share most bands, no two of them are alike enough, and some have near copies."""
    monkeypatch.setattr(simhash, "DENSE", 12)
    form = text(160)
    filled = [form + text(24) for _ in range(90)]
    rows = filled + [edits(w, "scattered") for w in filled[::6]]
    alike = {(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i], rows[j]) >= simhash.SIMILAR}
    assert alike == {(90 + k, 6 * k) for k in range(15)}
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(range(90))


def families(texts, words, changed, seed):
    """Copies of one text, each with words of its own in some places."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 3000, words)]
    out = []
    for k in range(texts):
        own = list(base)
        for at in rng.choice(words, rng.integers(*changed), replace=False):
            own[at] = f"x{k}y{at}"
        out.append(own)
    return out


def components_of(rows):
    sets = [set(simhash.shingle_set(" ".join(x).encode()).tolist()) for x in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            met = len(a & sets[j])
            if met >= simhash.SIMILAR * (len(a) + len(sets[j]) - met):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {i for i in range(len(rows)) if top(i) == i}


@pytest.mark.parametrize(("texts", "changed", "dense"), [(600, (3, 6), 2000), (500, (5, 7), 2000), (200, (3, 7), 40)])
def test_families_near_the_threshold_lose_no_link(spark, monkeypatch, texts, changed, dense):
    """Families in which estimates crowd out true links: as many stay as there are true components, also of groups in blocks."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rows = families(texts, 300, changed, 21)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == components_of(rows)


def test_groups_are_gone_through_exactly():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 900)
    sets = [np.unique(np.concatenate([rng.choice(base[:300], 300 - k, replace=False), rng.integers(0, 1 << 60, k)])) for k in rng.integers(0, 60, 80)]
    sets += [np.unique(x) for x in (base[300:900], base[300:880], base[:1], np.array([7]))]
    root = np.arange(len(sets))
    root[:20] = 0  # of one component already
    links = simhash.apart(sets, root)
    assert all(len(np.intersect1d(sets[i], sets[j])) >= simhash.SIMILAR * len(np.union1d(sets[i], sets[j])) for i, j in links)

    def merged(pairs):
        up = root.copy()
        for i, j in pairs:
            up[up == up[j]] = up[i]
        return {tuple(np.flatnonzero(up == x)) for x in set(up.tolist())}

    n = len(sets)
    assert merged(links) == merged([(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= simhash.SIMILAR * len(np.union1d(sets[i], sets[j]))])
    assert len(links) < n
