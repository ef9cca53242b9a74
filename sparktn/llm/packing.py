"""Best-fit packing by best-two-fit, decided on the histogram of piece lengths.

Documents are tokenised once; only those longer than a sequence are cut. There are at most `capacity`
different lengths, so best-two-fit runs on counts: a bin's pattern is filled greedily, its smallest piece
gives way to two unpacked ones that fit the gap more tightly, and the pattern is repeated for as long as
the sequential algorithm would have repeated it. The plan is a table of rank ranges for each length whose
size depends on the capacity alone; every piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, local_table, stored

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt int"
PLAN = dict.fromkeys(("length", "lo", "hi", "uses", "first", "base"), pa.int64())
#: Pieces that one rank group (a length and a salt) has on average.
GROUP_ROWS = 2_000
#: Texts that a worker encodes together, and entries of a generation of its cache; both bound its memory.
TEXTS, CACHE = 256, 100_000


def pieces_of(batches: Iterator[pa.RecordBatch], own, capacity: int, end_id: int, task: int) -> Iterator[pa.RecordBatch]:
    """The pieces of batches of doc_id and text, TEXTS texts at a time, so that a worker holds the ids of so many only."""
    from zlib import crc32

    import xxhash

    end, row = end_id.to_bytes(4, "little"), 0
    for batch in batches:
        for first in range(0, batch.num_rows, TEXTS):
            some, rows = batch.slice(first, TEXTS), []
            for doc, ids in zip(some.column(0).to_pylist(), own.encode(some.column(1))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(piece) // 4, crc32(piece), xxhash.xxh32_intdigest(f"{task} {row}") >> 1))
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, column: str = "text") -> DataFrame:
    """A row for each piece of each document: its ids and the end id, in cuts of the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder

        yield from pieces_of(batches, encoder(tokenizer, CACHE), capacity, end_id, TaskContext.get().partitionId())

    return in_batches(docs.select("doc_id", F.col(column).alias("text")), run, PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many, [(length, pieces of it in each)]) that hold all pieces."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths, bins = sorted(left), []
    while lengths:
        used, gap = {}, capacity
        at = len(lengths)
        while gap and (at := bisect_right(lengths, gap, 0, at)):
            n = lengths[at - 1]
            used[n] = take = min(left[n], gap // n)
            gap -= take * n
            at -= 1
        smallest = min(used)
        pair = closest_pair(lengths, lambda n: left[n] - used.get(n, 0), smallest, gap + smallest) if gap else None
        if pair:
            used[smallest] -= 1
            for n in pair:
                used[n] = used.get(n, 0) + 1
        used = {n: k for n, k in used.items() if k}
        times = min(left[n] // k for n, k in used.items())
        bins.append((times, sorted(used.items(), reverse=True)))
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                lengths.remove(n)
    return bins


def closest_pair(lengths: list[int], free, more: int, most: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest over `more` and up to `most`."""
    best, pair = more, None
    i, j = 0, bisect_right(lengths, most) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        if a + b > most or free(b) < 1:
            j -= 1
        elif free(a) < (2 if i == j else 1):
            i += 1
        else:
            if a + b > best:
                best, pair = a + b, (a, b)
                if best == most:
                    break
            i += 1
    return pair


def plan_rows(bins: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length, ranges of ranks with the first sequence, the pieces in each and their first place."""
    rows, rank, first = [], {}, 0
    for times, used in bins:
        base = 0
        for n, k in used:
            lo = rank.get(n, 0)
            rank[n] = lo + times * k
            rows.append((n, lo, rank[n], k, first, base))
            base += n * k
        first += times
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Null and empty texts are one piece that holds the end id. Null and repeated keys are packed as any
    row; equal rows may swap places. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    pieces = stored(cut(docs, tokenizer, capacity, end_id, column), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = local_table(spark, plan_rows(best_two_fit(counts, capacity)), **PLAN)
    salts = max(1, sum(counts.values()) // GROUP_ROWS)
    group = ["length", "salt"]
    pieces = pieces.withColumn("salt", F.pmod("salt", F.lit(salts)).cast("int"))
    before = pieces.groupBy(group).agg(F.count("*").alias("n")).select(*group, (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("rank", rank).join(before, group).withColumn("rank", F.col("before") + F.col("rank"))
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["lo"]) & (ranked["rank"] < plan["hi"])).drop(plan["length"])
    at = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(at / F.col("uses"))).alias("sequence_id"),
        (F.col("base") + at % F.col("uses") * F.col("length")).alias("offset"),
    )
