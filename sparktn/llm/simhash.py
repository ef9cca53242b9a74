"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Equal fingerprints are one node. Fingerprints that differ in few bits agree in whole blocks of bits, so each
node goes to one group for every choice of blocks that must agree. In a group, the fingerprints are sorted by
Gray rank; upper nodes hold the bit pattern that their members share under a mask, and a search drops a whole
subtree once the differences accumulated against its pattern exceed the limit. A group sends on the edges of
a spanning forest, never all its pairs; groups too large for one task are split by further blocks, which is
as exact. Components come from alternating large-star and small-star steps on these edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, in_batches, joined_by_key, kept, n_partitions, rows_of, small, stored

LIMIT, FANOUT = 4, 8
#: Nodes of a group from which it is split by further blocks.
GROUP_ROWS = 20_000
#: Times that a group is split; what is still large then is searched in one task, 24 bytes a node, where whole linked subtrees are passed over.
SPLITS = 2
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
SPACES = bytes([32, 9, 10, 11, 12, 13])
TO_SPACE = bytes(32 if i in SPACES else i for i in range(256))
#: Candidate pairs that the search of a group holds at a time, unless it has more nodes.
PAIRS = 1 << 22
U1 = np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    return [w for w in text.translate(ASCII_LOWER).translate(TO_SPACE).split(b" ") if w]


def shingled(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of all runs of so many words, one after the other."""
    from xxhash import xxh64_intdigest as h

    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends[: len(words) - shingle + 1] - [len(w) + 1 for w in words[: len(words) - shingle + 1]]).tolist()
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(starts))


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Of the words' shingles with repeats; shingle 0 takes each different word once."""
    from xxhash import xxh64_intdigest as h

    if not words:
        return 0
    if not shingle:
        words, shingle = list(set(words)), 1
    if len(words) <= shingle:
        return h(b" ".join(words), 42)  # one hash: each of its bits is set in over half of them or in none
    hashes = shingled(words, shingle)
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, column: str = "text", also: int | None = None) -> DataFrame:
    """doc_id, raw (XXH64 of the text), fp (the fingerprint's bits as a bigint) and other (that of another length of shingles, or 0) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        kept()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            words = map(words_of, texts)
            fps = np.array([(fingerprint(w, shingle), 0 if also is None else fingerprint(w, also)) for w in words], np.uint64).reshape(-1, 2).view(np.int64)
            raw = np.array([xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw), pa.array(fps[:, 0].copy()), pa.array(fps[:, 1].copy())], ["doc_id", "raw", "fp", "other"])

    return in_batches(docs.select("doc_id", F.coalesce(F.col(column), F.lit("")).alias("text")), run, "doc_id bigint, raw bigint, fp bigint, other bigint")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(s))
    return fp


def masks(free: int, blocks: int) -> list[int]:
    """The free bits as so many masks of nearly equal size."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in bits[i * len(bits) // blocks : (i + 1) * len(bits) // blocks]) for i in range(blocks)]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """gid, fixed (the bits that a group's members share), fp and other, for every choice of blocks that must agree.

    So many blocks are fixed that a group has some sixteen nodes on average if fingerprints are spread evenly.
    """
    n = nodes.count()
    blocks = next((limit + k for k in range(2, 5) if n >> 4 <= 1 << 64 * k // (limit + k)), limit + 5)
    parts = masks((1 << 64) - 1, blocks)
    fixed = [sum(c) for c in combinations(parts, blocks - limit)]
    long = [m - (1 << 64) if m >> 63 else m for m in fixed]
    return nodes.select(F.explode(F.array(*(F.lit(m).cast("bigint") for m in long))).alias("fixed"), "fp", "other").select(F.xxhash64("fixed", F.col("fp").bitwiseAND(F.col("fixed"))).alias("gid"), "fixed", "fp", "other")


def split(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of overfull groups in smaller ones: of limit + 1 blocks of the free bits, one must agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gid, fixed, fp, other = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(4))
            out = []
            for f in np.unique(fixed):
                own = fixed == f
                for k, m in enumerate(masks(~int(f) & (1 << 64) - 1, limit + 1)):
                    m = np.uint64(m)
                    out.append((mixed(mixed(gid[own], np.full(own.sum(), k + 1, np.uint64)), fp[own] & m), np.full(own.sum(), f | m), fp[own], other[own]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*out)], ["gid", "fixed", "fp", "other"])

    return in_batches(rows, run, "gid bigint, fixed bigint, fp bigint, other bigint")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up, self.edges = np.arange(n), []

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.roots()
        pairs, at = np.unique(np.sort(np.stack([root[a], root[b]]), axis=0), axis=1, return_index=True)
        for (x, y), i in zip(pairs.T.tolist(), at.tolist()):
            while self.up[x] != x:
                x = self.up[x]
            while self.up[y] != y:
                y = self.up[y]
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.edges.append((int(a[i]), int(b[i])))


def linked(fps: np.ndarray, others: np.ndarray, limit: int = LIMIT, apart: int = 64, block: int = 256) -> list[tuple[int, int]]:
    """Edges of a spanning forest of nodes at most `limit` bits apart, and `apart` in the other fingerprint, as positions."""
    n = len(fps)
    block = max(1, min(block, PAIRS // max(1, n)))
    order = np.argsort(gray_rank(fps), kind="stable")
    s, o = fps[order], others[order]
    forest = Forest(n)
    near = np.flatnonzero((np.bitwise_count(s[1:] ^ s[:-1]) <= limit) & (np.bitwise_count(o[1:] ^ o[:-1]) <= apart))
    if len(near):
        forest.link(near, near + 1)
    levels = [(s, np.full(n, ~np.uint64(0)))]  # from the leaves up: shared pattern and mask
    while len(levels[-1][0]) > FANOUT:
        pattern, mask = levels[-1]
        starts = np.arange(0, len(pattern), FANOUT)
        first = np.repeat(pattern[starts], np.diff([*starts, len(pattern)]))
        same = np.bitwise_and.reduceat(mask & ~(pattern ^ first), starts)
        levels.append((pattern[starts] & same, same))
    for lo in range(0, n, block):
        queries = np.arange(lo, min(n, lo + block))
        root = forest.roots()
        only = [root]  # the component of all members of a node, or -1
        for pattern, _ in levels[1:]:
            starts = np.arange(0, len(only[-1]), FANOUT)
            least, most = np.minimum.reduceat(only[-1], starts), np.maximum.reduceat(only[-1], starts)
            only.append(np.where(least == most, least, -1))
        top = len(levels) - 1
        q = np.repeat(queries, len(levels[top][0]))
        node = np.tile(np.arange(len(levels[top][0])), len(queries))
        for level in range(top, -1, -1):
            pattern, mask = levels[level]
            last = (node + 1) * FANOUT**level - 1
            keep = (last > q) & (only[level][node] != root[q])
            q, node = q[keep], node[keep]
            keep = np.bitwise_count((s[q] ^ pattern[node]) & mask[node]) <= limit
            q, node = q[keep], node[keep]
            if level:
                below = len(levels[level - 1][0])
                q, node = np.repeat(q, FANOUT), (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                keep = node < below
                q, node = q[keep], node[keep]
        keep = (node > q) & (np.bitwise_count(o[q] ^ o[node]) <= apart)
        if keep.any():
            forest.link(q[keep], node[keep])
    return [(int(order[a]), int(order[b])) for a, b in forest.edges]


def group_edges(rows: DataFrame, partitions: int, limit: int = LIMIT, apart: int = 64) -> DataFrame:
    """a, a2, b, b2: edges between nodes of one group, enough to connect what is linked in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.uint64)] * 3

        def edges(gid: np.ndarray, fp: np.ndarray, other: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]])) if len(gid) else np.empty(0, int)
            sizes = np.diff([*starts, len(gid)])
            two = starts[sizes == 2]
            two = two[(np.bitwise_count(fp[two] ^ fp[two + 1]) <= limit) & (np.bitwise_count(other[two] ^ other[two + 1]) <= apart)]
            a, b = [two], [two + 1]
            for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                found = linked(fp[at : at + n], other[at : at + n], limit, apart)
                if found:
                    i, j = np.array(found).T
                    a.append(i + at)
                    b.append(j + at)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (fp[a], other[a], fp[b], other[b])], ["a", "a2", "b", "b2"])

        for batch in batches:
            now = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64)]) for i, r in enumerate(rest)]
            gid = now[0]
            whole = int(np.flatnonzero(gid != gid[-1])[-1]) + 1 if len(gid) and gid[0] != gid[-1] else 0
            yield from edges(*(x[:whole] for x in now))
            rest = [x[whole:] for x in now]
        yield from edges(*rest)

    return in_batches(rows.select("gid", "fp", "other").repartition(partitions, "gid").sortWithinPartitions("gid"), run, "a bigint, a2 bigint, b bigint, b2 bigint")


def edges(nodes: DataFrame, limit: int = LIMIT, group_rows: int = GROUP_ROWS, apart: int = 64) -> DataFrame:
    """a, b: edges, by node number, that connect all nodes at most `limit` bits apart, and `apart` in the other fingerprint."""
    parts = n_partitions(nodes.sparkSession)
    rows, found = grouped(nodes, limit), None
    for level in range(SPLITS + 1):
        hot = small(stored(rows.groupBy("gid").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("gid"), "hot"), 200_000)
        some = level < SPLITS and not hot.isEmpty()
        calm = rows.join(hot, "gid", "left_anti") if some else rows
        new = group_edges(calm, parts, limit, apart)
        found = new if found is None else found.unionByName(new)
        if not some:
            return found.select(node_of("a", "a2").alias("a"), node_of("b", "b2").alias("b")).distinct()
        rows = stored(split(rows.join(hot, "gid", "left_semi").select("gid", "fixed", "fp", "other"), limit), "groups")


def components(pairs: DataFrame) -> DataFrame:
    """node, root: the least node of each component of the edges a, b. Nodes with many edges are no single task's."""
    now = stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (got["n"], got["h"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (got["n"], got["h"])
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # each step is written, as joined_by_key reads its tables several times and plans of plans would grow
        least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        large = stored(joined_by_key(both, least, ["a"], "n", 2 * got["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = joined_by_key(large, low, ["a"], "n", got["n"])
        now = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")


def node_of(fp: str, other: str) -> Column:
    """A node's number: the fingerprint, or a hash of both where there is another."""
    return F.when(F.col(other) == 0, F.col(fp)).otherwise(F.xxhash64(fp, other))


def near_groups(docs: DataFrame, shingle: int = 4, limit: int = LIMIT, column: str = "text", group_rows: int = GROUP_ROWS, also: int | None = None, apart: int = 64) -> DataFrame:
    """doc_id, raw, fingerprint, component_id for every row.

    With `also`, links are checked: fingerprints of that length of shingles must differ in at most `apart` bits.

    Null and empty texts and those without words have fingerprint zero, which links as any other. The
    component_id is the smallest doc_id that links reach; null keys count for it only where a component
    has no other, which then is null. Repeated rows share their node. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, shingle, column, also).withColumn("node", node_of("fp", "other")), "fingerprints")
    nodes = stored(prints.groupBy("node", "fp", "other").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    size = nodes.agg(F.count("*").alias("nodes"), F.sum("n").alias("rows")).first()
    root = components(edges(nodes.select("fp", "other"), limit, group_rows, apart))
    joined = nodes.join(root, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    member = joined_by_key(joined, ids, ["root"], "m", size["nodes"] or 0).select("node", "n", "component_id")
    return joined_by_key(prints, member, ["node"], "n", size["rows"] or 0).select("doc_id", "raw", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near copies of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more.
#: Candidates are in one component of fingerprints, by the hierarchical index, or agree in all ROWS minima of one of BANDS
#: bands: of pairs at 0.8, 1 - (1 - 0.8^5)^24 = 99.99 %, whatever the edit. The exact check follows for both.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 24, 5
#: Share of equal minima from which a candidate is checked (0.8 less three deviations), and partners checked for each member of a band's group.
LIKELY, PARTNERS = 0.69, 3
#: Members of a band's group that one task compares. Of a larger group, members with TIGHT equal minima are searched through
#: one of them, in parts of this size, for as long as it shrinks; then any two of its members meet in a block of this size.
DENSE, TIGHT = 2_000, 0.9
#: Members of a group whose shingles a task holds at once on either side, where pairs are checked; and shingles that a member
#: has on average in the blocks of large groups or long texts that are gone through whole.
TILE, MEMBER = 64, 2_000
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + U1


def shingle_set(text: bytes) -> np.ndarray:
    """Different hashes of the five-word shingles; a shorter text, or one without words, is one shingle."""
    from xxhash import xxh64_intdigest as h

    words = words_of(text)
    return np.unique(shingled(words, SHINGLE)) if len(words) > SHINGLE else np.array([h(b" ".join(words), 42)], np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(FACTORS), ~np.uint64(0))
    for at in range(0, len(hashes), 512):
        np.minimum(least, np.multiply.outer(hashes[at : at + 512], FACTORS).min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, raw (XXH64 of the text), fp (the fingerprint of four-word shingles), keys (a hash of each band) and sketch (the low byte of each minimum) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        kept()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            raw = np.array([xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)
            fps = np.array([fingerprint(words_of(t), 4) for t in texts], np.uint64).view(np.int64)
            least = np.array([minima(shingle_set(t)) for t in texts], np.uint64).reshape(-1, BANDS, ROWS)
            keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(texts), 1))
            for r in range(ROWS):
                keys = mixed(keys, least[:, :, r])
            sketch = [x.tobytes() for x in least.reshape(len(texts), -1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw), pa.array(fps), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "raw", "fp", "keys", "sketch"])

    return in_batches(docs.select("doc_id", F.coalesce(F.col(column), F.lit("")).alias("text")), run, "doc_id bigint, raw bigint, fp bigint, keys array<bigint>, sketch binary")


def indexed(prints: DataFrame) -> DataFrame:
    """prints with one more key, the first: that of the component of fingerprints at most LIMIT bits apart, by the hierarchical index."""
    nodes = stored(prints.groupBy("fp").agg(F.count("*").alias("n")), "nodes")
    root = components(edges(nodes.select("fp", F.lit(0).cast("bigint").alias("other"))))
    keyed = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "n", F.xxhash64(F.coalesce("root", "fp"), F.lit(LIMIT)).alias("key"))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    return joined_by_key(prints, keyed, ["fp"], "n", total).select("doc_id", "raw", F.concat(F.array("key"), "keys").alias("keys"), "sketch")


def heads(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of which none has TIGHT equal minima with another, and pairs of such a member and one that it stands for."""
    a, b, chosen, left = [np.empty(0, int)], [np.empty(0, int)], [], np.arange(len(sketch))
    while len(left):
        head = left[0]
        tight = (sketch[left] == sketch[head]).sum(axis=1) >= TIGHT * sketch.shape[1]
        tight[0] = True
        chosen.append(head)
        a.append(np.full(int(tight.sum()) - 1, head))
        b.append(left[tight][1:])
        left = left[~tight]
    return np.array(chosen, int), np.concatenate(a), np.concatenate(b)


def likely(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs to check in a group, at most 1 + PARTNERS for each member: a spanning forest of the most equal minima and each member's best partners.

    These are the first pairs to check; what they leave apart, `settled` goes through. It holds a few numbers a member at a
    time, never all pairs.
    """
    n, floor = len(sketch), LIKELY * sketch.shape[1]
    chosen, *pairs = heads(sketch) if n > DENSE else (np.arange(n), np.empty(0, int), np.empty(0, int))
    a, b = [pairs[0]], [pairs[1]]
    own = sketch[chosen]
    k = len(chosen)
    best, at, out = np.full(k, -1), np.zeros(k, int), np.ones(k, bool)
    now = 0
    for _ in range(k):
        out[now] = False
        if best[now] >= floor:
            a.append(chosen[[at[now]]])
            b.append(chosen[[now]])
        equal = (own == own[now]).sum(axis=1)
        equal[now] = -1
        top = np.argpartition(equal, -PARTNERS)[-PARTNERS:] if k > PARTNERS else np.arange(k)
        top = top[equal[top] >= floor]
        a.append(np.full(len(top), chosen[now]))
        b.append(chosen[top])
        nearer = out & (equal > best)
        best[nearer], at[nearer] = equal[nearer], now
        now = int(np.argmax(np.where(out, best, -2)))
    return np.concatenate(a), np.concatenate(b)


def pair_columns(i: np.ndarray, j: np.ndarray, raw: np.ndarray, gid: np.ndarray, start: np.ndarray) -> list[pa.Array]:
    """a, b, home and tile of the pairs of places i and j, each once; start is where a place's group starts."""
    x, y = raw[i], raw[j]
    both, first = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1, return_index=True)
    i, j = i[first], j[first]
    p, q = (i - start[i]) // TILE, (j - start[j]) // TILE
    return [pa.array(np.ascontiguousarray(c)) for c in (both[0], both[1], gid[i], np.minimum(p, q) << 32 | np.maximum(p, q))]


def once(pairs: DataFrame) -> DataFrame:
    """a, b, home, tile: every pair in one of the groups that found it, the same for pairs that share it."""
    return pairs.groupBy("a", "b").agg(F.min(F.struct("home", "tile")).alias("at")).select("a", "b", "at.home", "at.tile")


def compared(members: DataFrame, partitions: int) -> DataFrame:
    """a, b: pairs of raw to check, with the group (home) and the tile of it they are from; and of parts of large groups, the
    members that stand for others as gid, band and raw in a.

    From gid, band, part (-1: the group is whole), raw and sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 4 + [np.empty((0, BANDS * ROWS), np.uint8)]

        def pairs(gid: np.ndarray, part: np.ndarray, band: np.ndarray, raw: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], (gid[1:] != gid[:-1]) | (part[1:] != part[:-1])])) if len(gid) else np.empty(0, int)
            sizes = np.diff([*starts, len(gid)])
            whole = part[starts] < 0
            two = starts[whole & (sizes == 2)]
            two = two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= LIKELY * sketch.shape[1]]
            a, b, stay = [two], [two + 1], [np.empty(0, int)]
            more = whole & (sizes > 2) | ~whole
            for at, n, all_of_it in zip(starts[more].tolist(), sizes[more].tolist(), whole[more].tolist()):
                if all_of_it:
                    i, j = likely(sketch[at : at + n])
                else:
                    k, i, j = heads(sketch[at : at + n])
                    stay.append(k + at)
                a.append(i + at)
                b.append(j + at)
            i, j, k = np.concatenate(a), np.concatenate(b), np.concatenate(stay)
            if len(i) or len(k):
                edges = pair_columns(i, j, raw, gid, np.repeat(starts, sizes))
                none = pa.nulls(len(edges[0]), pa.int64())
                edges = [*edges[:2], none, none, *edges[2:]]
                empty = pa.nulls(len(k), pa.int64())
                standing = [pa.array(raw[k]), empty, pa.array(gid[k]), pa.array(band[k]), empty, empty]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(edges, standing)], ["a", "b", "gid", "band", "home", "tile"])

        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
            now = [np.concatenate([r, x]) for r, x in zip(rest, (*(batch.column(i).to_numpy() for i in range(4)), sketch))]
            gid, part = now[:2]
            whole = int(np.flatnonzero((gid != gid[-1]) | (part != part[-1]))[-1]) + 1 if len(gid) and (gid[0], part[0]) != (gid[-1], part[-1]) else 0
            yield from pairs(*(x[:whole] for x in now))
            rest = [x[whole:] for x in now]
        yield from pairs(*rest)

    rows = members.select("gid", "part", "band", "raw", "sketch").repartition(partitions, "gid", "part")
    return in_batches(rows.sortWithinPartitions("gid", "part", F.xxhash64("gid", "raw")), run, "a bigint, b bigint, gid bigint, band bigint, home bigint, tile bigint")


def dealt(members: DataFrame, level: int) -> DataFrame:
    """members with the part of their group: whole groups of DENSE at most, random parts of others, and of `final` groups blocks in which any two members meet."""
    large, own = F.col("n") > DENSE, F.xxhash64("raw", F.lit(level))
    parts, halves = F.ceil(F.col("n") / DENSE), F.ceil(2 * F.col("n") / DENSE)
    whole = members.where(~(large & F.col("final"))).withColumn("part", F.when(large, F.pmod(own, parts)).otherwise(-1))
    met = members.where(large & F.col("final")).withColumn("own", F.pmod(own, halves)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), halves - 1))).where("own <> other")
    blocks = met.withColumn("gid", F.xxhash64("gid", F.least("own", "other"), F.greatest("own", "other"))).withColumn("part", F.lit(-1))
    return whole.unionByName(blocks.drop("own", "other")).withColumn("part", F.col("part").cast("bigint"))


def candidates(prints: DataFrame) -> DataFrame:
    """a, b, home, tile: pairs of raw, a < b, whose shingles are to be compared first.

    Texts that share a key, of the fingerprints' component or of a band, are a group. A task compares DENSE members at most: larger groups are dealt in
    parts, of which those that stand for others are dealt again. A group that this doesn't halve is dealt by a
    further band the first time; after that all its members are compared, in blocks. Whatever this leaves apart within
    a group is for `settled`.
    """
    parts = n_partitions(prints.sparkSession)
    one = stored(prints.select("raw", "keys", "sketch").dropDuplicates(["raw"]), "texts")
    rows = one.select("raw", F.posexplode("keys").alias("band", "gid")).select("raw", F.col("band").cast("bigint").alias("band"), "gid", F.lit(False).alias("final"))
    found, level = None, 0
    while True:
        counts = stored(rows.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1"), "groups")
        size = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
        members = joined_by_key(rows, counts, ["gid"], "n", size["total"] or 0).join(one.select("raw", "sketch"), "raw")
        out = stored(compared(dealt(members, level), parts), "candidates")
        new = out.where("gid is null").select("a", "b", "home", "tile")
        found = new if found is None else found.unionByName(new)
        if (size["most"] or 0) <= DENSE:
            return once(found)
        left = out.where("gid is not null").select(F.col("a").alias("raw"), "band", "gid")
        after = left.groupBy("gid").agg(F.count("*").alias("m")).where(F.col("m") > DENSE)
        slow = small(stored(counts.join(after, "gid").where("m > n / 2").select("gid"), "groups"), 200_000)
        rows, again = left.join(slow, "gid", "left_anti").withColumn("final", F.lit(False)), left.join(slow, "gid", "left_semi")
        if level == 0:
            further = again.join(one.select("raw", "keys"), "raw").select("raw", "gid", "band", F.posexplode("keys").alias("next", "key")).where("next > band")
            again = further.select("raw", F.col("next").cast("bigint").alias("band"), F.xxhash64("gid", "key").alias("gid"))
        rows, level = rows.unionByName(again.withColumn("final", F.lit(level > 0))), level + 1


def shingle_sets(docs: DataFrame, asked: DataFrame, column: str = "text") -> DataFrame:
    """raw and shingles of the texts asked for, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["raw", "shingles"])

    text = F.coalesce(F.col(column), F.lit(""))
    own = docs.select(F.xxhash64(text).alias("raw"), text.alias("text")).join(small(asked, 500_000), "raw", "left_semi")
    return stored(in_batches(own, run, "raw bigint, shingles array<bigint>").dropDuplicates(["raw"]), "shingles")


def asked_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("raw")).distinct()


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, home, tile) whose sets of shingles have a Jaccard similarity of SIMILAR or more, all shingles compared.

    A text's shingles are sent to each tile that asks for it, once, and not to each of its pairs, so a text in thousands of
    pairs is no hot key; a task holds the texts of one tile, 2 TILE at most.
    """
    parts = n_partitions(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            home, tile, a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            sets, found = batch.column(4), []
            for k in range(batch.num_rows):
                if (home[k], tile[k]) != at:
                    at, held = (home[k], tile[k]), {}
                if sets[k].is_valid:
                    held[a[k]] = sets.slice(k, 1).flatten().to_numpy(zero_copy_only=False)
                else:
                    x, y = held[a[k]], held[b[k]]
                    # of sets whose sizes alone forbid it, nothing is met
                    if min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)):
                        met = len(np.intersect1d(x, y, assume_unique=True))
                        if met >= SIMILAR * (len(x) + len(y) - met):
                            found.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a[found], pa.int64()), pa.array(b[found], pa.int64())], ["a", "b"])

    wanted = pairs.select("home", "tile", F.explode(F.array("a", "b")).alias("raw")).distinct()
    texts = wanted.join(sets, "raw").select("home", "tile", F.col("raw").alias("a"), F.lit(0).cast("bigint").alias("b"), "shingles")
    rows = texts.unionByName(pairs.select("home", "tile", "a", "b", F.lit(None).cast("array<bigint>").alias("shingles")))
    return in_batches(rows.repartition(parts, "home", "tile").sortWithinPartitions("home", "tile", F.col("shingles").isNull()), run, "a bigint, b bigint")


def apart(sets: list[np.ndarray], root: np.ndarray) -> list[tuple[int, int]]:
    """Of a group, links that join all components that any link between two of them joins.

    Every member outside the largest component meets all members of other components, exactly: of each of its shingles the
    members that have it are counted, which takes time by the shingles that are shared and memory by the group's own.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    members, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(shingle))])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    label = np.unique(root, return_inverse=True)[1]
    links = []
    largest = np.bincount(label).argmax()
    for i in np.flatnonzero(label != largest):
        if (label == label[i]).all():
            break
        own = shingle[ends[i] : ends[i + 1]]
        met = np.zeros(n, np.int64)
        for part in np.split(own, range(512, len(own), 512)):  # what a part is met by is held at once
            at, counts = first[part], first[part + 1] - first[part]
            places = np.repeat(at - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            met += np.bincount(members[places], minlength=n)
        for j in np.flatnonzero((met >= SIMILAR * (sizes + sizes[i] - met)) & (label != label[i])):
            if label[j] != label[i]:
                links.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return links


def joined_groups(members: DataFrame, partitions: int) -> DataFrame:
    """a, b: links between members of different components, group by group; from gid, raw, root and shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raw, root, sets = None, [], [], []

        def links() -> Iterator[pa.RecordBatch]:
            if len(raw) > 1:
                found = [(raw[i], raw[j]) for i, j in apart(sets, np.array(root, np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for gid, own, top, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), range(batch.num_rows)):
                if gid != now:
                    yield from links()
                    now, raw, root, sets = gid, [], [], []
                raw.append(own)
                root.append(top)
                sets.append(batch.column(3).slice(k, 1).flatten().to_numpy(zero_copy_only=False).copy())
        yield from links()

    rows = members.select("gid", "raw", "root", "shingles").repartition(partitions, "gid").sortWithinPartitions("gid")
    return in_batches(rows, run, "a bigint, b bigint")


def settled(docs: DataFrame, prints: DataFrame, pairs: DataFrame, column: str = "text") -> DataFrame:
    """node, root: the components of all pairs that share a component of fingerprints or a band and that the exact check confirms.

    First the pairs given are checked. Then every such group that still has different components is gone through whole, with
    all shingles of its members, and what links two components joins them. Groups of one component, and groups so small
    that all their pairs are among those given, are left out. Large groups, and groups of long texts, are gone through in
    blocks in which any two members meet. No pair that isn't a link leaves a task.
    """
    parts = n_partitions(prints.sparkSession)
    sets = shingle_sets(docs, asked_of(pairs), column)
    found = stored(alike(pairs, sets), "alike")
    root = components(found)
    one = prints.select("raw", "keys").dropDuplicates(["raw"])
    rows = one.select("raw", F.explode("keys").alias("gid"))
    counts = stored(rows.groupBy("gid").agg(F.count("*").alias("n")).where(F.col("n") > PARTNERS + 1), "groups")
    total = counts.agg(F.sum("n")).first()[0] or 0
    members = joined_by_key(rows, counts, ["gid"], "n", total)

    def rooted(df: DataFrame) -> DataFrame:
        return df.join(root.withColumnRenamed("node", "raw"), "raw", "left").withColumn("root", F.coalesce("root", "raw"))

    known = stored(rooted(members).join(sets.select("raw", F.size("shingles").alias("size")), "raw", "left"), "members")
    ends = known.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("n"), F.bit_xor(F.xxhash64("raw")).alias("same"), F.sum(F.coalesce("size", F.lit(MEMBER))).alias("size"))
    live = ends.where("low <> high").groupBy("n", "low", "high", "same", "size").agg(F.min("gid").alias("gid"))  # groups of the same members are one
    live = stored(live.select("gid", F.greatest(F.col("n"), F.ceil(F.col("size") / MEMBER)).alias("n"), F.col("n").alias("count")), "groups")
    if live.isEmpty():
        return root
    again = joined_by_key(known.select("gid", "raw", "root"), live, ["gid"], "count", total)
    blocks = dealt(again.withColumn("band", F.lit(0)).withColumn("final", F.lit(True)), 0).select("gid", "raw", "root")
    blocks = stored(blocks, "blocks")
    new = stored(blocks.select("raw").distinct().join(sets.select("raw"), "raw", "left_anti"), "asked")
    if not new.isEmpty():
        sets = sets.unionByName(shingle_sets(docs, new, column))
    links = stored(joined_groups(blocks.join(sets, "raw"), parts), "links")
    if links.isEmpty():
        return root
    # few links join components that are known: only their roots meet anew
    ends = links.select(F.posexplode(F.array("a", "b")).alias("side", "raw"), F.xxhash64("a", "b").alias("link"))
    tops = rooted(ends).groupBy("link").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    top = components(tops).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = root.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(top.select(F.col("root").alias("node"), F.col("top").alias("root")))


def keep_one(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with one row of each component of near copies, that of the smallest doc_id; columns as they are, whatever their names.

    Equal texts are one node; null, empty and wordless texts are equal to the text of no word. Rows without a
    doc_id stay only where a component has no other; of rows with one key and text any one stays. Long texts are
    compared whole. An empty table stays empty.
    """
    prints = stored(indexed(stored(sketches(docs, column), "sketches")), "indexed")
    pairs = stored(candidates(prints), "candidates")
    root = settled(docs, prints, pairs, column).withColumnRenamed("node", "raw")
    least = prints.groupBy("raw").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("s"))
    stay = least.join(root, "raw", "left").groupBy(F.coalesce("root", "raw").alias("root")).agg(F.min("s").alias("s"))
    return rows_of(docs, stay.select("s.doc_id", "s.raw"), column)
