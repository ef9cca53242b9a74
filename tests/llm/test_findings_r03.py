"""Rules beyond a URL's most telling tokens, and near copies by fingerprints."""

from itertools import combinations

import numpy as np
import pyarrow as pa

from sparktn.llm import exact_dedup, packing, simhash, toxicity, url_filter
from sparktn.llm.queries import tokenizer_path


def test_rules_beyond_the_basket(spark):
    """every URL has more frequent tokens than a basket; all sets of three tokens at most, by brute force."""
    front = [f"t{k:02d}" for k in range(url_filter.BASKET + 2)]
    rows = [([*front, "y", "z"], "block")] * 40 + [(["y", "q"], "allow")] * 20 + [(["z", "q"], "allow")] * 20
    got = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, known string"), 0.1, 0.8).collect()
    least, want = max(url_filter.LEAST, 0.1 * len(rows)), {}
    for size in range(1, url_filter.LONGEST + 1):
        for own in combinations(sorted({t for r, _ in rows for t in r}), size):
            fits = [v for r, v in rows if set(own) <= set(r)]
            for verdict in ("block", "allow"):
                hits = fits.count(verdict)
                if hits >= least and hits >= 0.8 * len(fits):
                    want[own, verdict] = hits / len(fits)
    want = {k: c for k, c in want.items() if not any(v == k[1] and d >= c and set(s) < set(k[0]) for (s, v), d in want.items())}
    assert (("y", "z"), "block") in want
    assert {(tuple(r["tokens"]), r["verdict"]): r["confidence"] for r in got} == want


def test_near_copies_by_fingerprints(spark):
    """texts whose fingerprints reach each other are candidates though they share no band; others aren't."""
    fps = [0, 0b1111, 0b11111111, 1 << 40 | 0b111111111111]
    sketch = bytes(simhash.BANDS * simhash.ROWS)
    rows = [(k, 100 + k, fp, [1000 * k + b for b in range(simhash.BANDS)], sketch) for k, fp in enumerate(fps)]
    prints = simhash.indexed(spark.createDataFrame(rows, "doc_id bigint, raw bigint, fp bigint, keys array<bigint>, sketch binary"))
    assert {(r["a"], r["b"]) for r in simhash.candidates(prints).collect()} == {(100, 101), (100, 102), (101, 102)}
    docs = spark.createDataFrame([(0, "a b c d e f"), (1, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["fp"] for r in simhash.sketches(docs).collect()}
    assert got == {r["doc_id"]: r["fp"] for r in simhash.fingerprints(docs).collect()}


def test_packing_holds_the_ids_of_few_texts():
    """A worker encodes TEXTS texts at a time, however many a batch has; pieces and their salts are those of all."""

    class Own:
        most = 0

        def encode(self, texts):
            Own.most = max(Own.most, len(texts))
            return [np.arange(len(t), dtype="<u4").tobytes() for t in texts.to_pylist()]

    n = 2 * packing.TEXTS + 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["x" * (k % 7) for k in range(n)])], ["doc_id", "text"])
    got = [r for b in packing.pieces_of(iter([batch]), Own(), 4, 0, 3) for r in b.to_pylist()]
    assert Own.most == packing.TEXTS and len({r["salt"] for r in got}) == len(got)
    want = [(k, piece, 4 * piece, min(4, k % 7 + 1 - 4 * piece)) for k in range(n) for piece in range(-(-(k % 7 + 1) // 4))]
    assert [(r["doc_id"], r["piece"], r["start"], r["length"]) for r in got] == want


def test_workers_get_few_megabytes_at_once(spark):
    """pipeline: batches of whole texts are bounded by their bytes for every stage, not by 10,000 rows or 64 MB; a bound of the session's own stays."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    steps = [lambda d, labels: toxicity.keep_clean(d, labels), lambda d, _: exact_dedup.digest(d, "text"), lambda d, _: simhash.sketches(d), lambda d, _: simhash.fingerprints(d), lambda d, _: packing.cut(d, tokenizer_path())]
    for step in steps:
        own = spark.newSession()
        docs = own.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('x', 10000) as text")
        step(docs, own.createDataFrame([], "doc_id bigint, toxic int"))
        got = [r["n"] for r in docs.mapInArrow(sizes, "n bigint").collect()]
        assert sum(got) > 30_000_000 and max(got) < 8 << 20
        own.conf.set(key, 1 << 20)
        step(docs, own.createDataFrame([], "doc_id bigint, toxic int"))
        assert int(own.conf.get(key)) == 1 << 20


def test_packing_plan_needs_no_other_workers(spark):
    """pipeline: the plan's rows come from the driver as they are, without an RDD that Python workers of another kind serialise."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    packed = packing.pack(docs, tokenizer_path())
    assert "ExistingRDD" not in packed._jdf.queryExecution().toString()
    assert sorted((r["doc_id"], r["length"]) for r in packed.collect())[1] == (2, 1)
