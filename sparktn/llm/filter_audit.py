"""Filter interaction audit: what each of five filters removes, alone and after others, in every order.

A document that passes the filters of a subset survives it. With five filters there are 32 subsets, so a document is one
32-bit word whose bit S is set if it survives subset S. Adding up the bits of all words by place (a positional popcount,
by carry-save adders) counts the survivors of every subset, and all figures of all orders follow from these counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of a text that are split into words at once; a longer text is split part by part, at blanks.
PART = 4 << 20
#: Parts of the corpus whose counts a task holds before it hands them on.
HELD = 4096
#: By the set of failed filters: the word of the subsets that have none of them.
WORDS = np.array([sum(1 << s for s in range(32) if not s & failed) for failed in range(32)], np.uint32)


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and different words of a text; bytes.split knows exactly the blanks 20 and 09 to 0D."""
    if len(text) <= PART:
        words = text.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(text):
        blank = BLANK.search(text, min(at + PART, len(text)))
        end = blank.start() if blank else len(text)
        words = text[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def failed(text: str) -> tuple[int, bytes]:
    """The filters A to D that a text fails, as bits 0 to 3, and its SHA-256."""
    raw = text.encode()
    n, different = word_counts(raw)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    bits = (n < 200) | (100 * different < 50 * n) << 1 | (100 * capitals > 2 * len(text)) << 2 | bool(MARKS.search(raw)) << 3
    return bits, hashlib.sha256(raw).digest()


def popcounts(words: np.ndarray) -> np.ndarray:
    """How often each of the 32 bits is set, by carry-save adders.

    Three words of one weight become a sum of that weight and a carry of twice the weight, bit by bit for all 32 places
    at once, until two words at most are left of each weight.
    """
    total, level, weight = np.zeros(32, np.int64), words.astype(np.uint32), 1
    while len(level):
        carries = []
        while len(level) >= 3:
            m = len(level) // 3
            x, y, z = level[:m], level[m : 2 * m], level[2 * m : 3 * m]
            half = x ^ y
            carries.append((x & y) | (half & z))
            level = np.concatenate([half ^ z, level[3 * m :]])
        total += weight * ((level[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64)
        level, weight = np.concatenate(carries) if carries else level[:0], 2 * weight
    return total


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed (filters A to D) and digest of every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bits, digests = [], []
            for text in batch.column(2):  # one text at a time, so that no more than one is held as words
                b, digest = failed(text.as_py() or "")
                bits.append(b)
                digests.append(digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "failed", "digest"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return own.mapInArrow(run, "doc_id bigint, part string, failed int, digest binary")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, failed (all five filters as bits), good and toxic.

    Texts are compared by SHA-256. The first doc_id of repeated texts is a table of its own, in which a text has one row
    however many copies it has, so copies are summed up where they are read and a hot text's rows can be split in the join.
    """
    facts = stored(marked(docs), "audit")
    first = facts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("good or toxic")
    first, known = stored(first, "first"), stored(known, "known")
    joined = facts.join(small(first, 100_000), "digest", "left").join(small(known, 200_000), F.col("doc_id") == F.col("key"), "left")
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    none = F.lit(False)
    return joined.select("doc_id", "part", F.col("failed").bitwiseOR(repeated * 16).alias("failed"), F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))


def survivors(rows: DataFrame) -> DataFrame:
    """part and n: an array of how many documents, good ones and toxic ones (32 numbers each) survive each subset.

    A task adds up its documents' words by part and hands on 96 numbers a part, so a part of any size is spread over all
    tasks; a task that meets very many parts hands on what it has and starts anew.
    """

    def run(batches):
        import pyarrow as pa

        def out(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.ravel() for c in counts.values()], pa.list_(pa.int64()))], ["part", "n"])

        held: dict[str, np.ndarray] = {}
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            codes = parts.indices.to_numpy()
            words = WORDS[batch.column(1).to_numpy()]
            good, toxic = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            order = np.argsort(codes, kind="stable")
            ends = np.cumsum(np.bincount(codes, minlength=len(parts.dictionary)))
            for name, at in zip(parts.dictionary.to_pylist(), np.split(order, ends[:-1])):
                w = words[at]
                counts = np.stack([popcounts(w), popcounts(w[good[at]]), popcounts(w[toxic[at]])])
                held[name] = held[name] + counts if name in held else counts
            if len(held) > HELD:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    counted = rows.select("part", "failed", "good", "toxic").mapInArrow(run, "part string, n array<bigint>")
    summed = counted.groupBy("part").agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(96)))
    return summed.select("part", F.array(*(f"n{k}" for k in range(96))).alias("n"))


def steps() -> str:
    """All orders and steps as JSON: the filter, and the subsets before and after the step."""
    out = []
    for order in ORDERS:
        before = 0
        for k, name in enumerate(order):
            f = FILTERS.index(name)
            out.append({"filter_order": order, "step": k + 1, "f": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    return json.dumps(out)


def shapley(f: int):
    """What the filter removes over all orders: a subset stands before it in (its size)! (4 - its size)! orders."""
    terms = [(F.col("n")[s] - F.col("n")[s | 1 << f]) * (factorial(s.bit_count()) * factorial(4 - s.bit_count())) for s in range(32) if not s >> f & 1]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source; null: empty), filter_order (all 120) and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley.

    Null text counts as empty and fails A only (and E, if it isn't the first such row). Rows that repeat doc_id and text
    are all counted and none is a copy of another, as neither id is smaller; a row without doc_id is no copy and makes none, and
    has no labels. Of several labels of a document one is enough. Long texts are read whole, in parts; columns other than
    doc_id, text and source aren't read. Without documents there are no rows, without labels nothing is lost.
    """
    n = survivors(failures(docs, labels)).withColumn("shapleys", F.array(*(shapley(f) for f in range(5))))
    plan = F.from_json(F.lit(steps()), "array<struct<filter_order: string, step: int, f: int, before: int, after: int>>")
    rows = n.select("part", "n", "shapleys", F.explode(plan).alias("o"))
    at = lambda subset, label=0: F.get("n", subset + 32 * label)
    before, after = F.col("o.before"), F.col("o.after")
    bit = after - before
    removed = at(before) - at(after)
    return rows.select(
        "part", "o.filter_order", "o.step", at(after).alias("kept"), removed.alias("removed"),
        (at(F.lit(0)) - at(bit) - removed).alias("redundant"), (at(F.lit(31) - bit) - at(F.lit(31))).alias("unique_fails"),
        (at(before, 1) - at(after, 1)).alias("good_lost"), (at(before, 2) - at(after, 2)).alias("toxic_lost"), F.get("shapleys", F.col("o.f")).alias("shapley"),
    )


#: DuckDB SQL for audit() of the tables documents and labels.
SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by t) as first from d),
m as (select doc_id, part, (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
        + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as f from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (select part, f, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l using (doc_id) group by part, f),
x as (select range as k, chr(65 + range::int) as name, (1 << range)::int as bit from range(5)),
o as (select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
        from x a, x b, x c, x d, x e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, range::int as step, bits[range] as bit, coalesce(list_sum(bits[1 : range - 1]), 0)::int as before from o, range(1, 6)),
r as (select part, filter_order, step, bit,
        sum(n) filter (f & (before | bit) = 0) as kept, sum(n) filter (f & before = 0 and f & bit <> 0) as removed, sum(n) filter (f & before <> 0 and f & bit <> 0) as redundant, sum(n) filter (f = bit) as unique_fails,
        sum(good) filter (f & before = 0 and f & bit <> 0) as good_lost, sum(toxic) filter (f & before = 0 and f & bit <> 0) as toxic_lost
        from c, s group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
    coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley
from r"""
