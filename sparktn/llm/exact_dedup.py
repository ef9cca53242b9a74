"""Exact dedup with an extendible-hash index whose pages are files in the shared folder.

Map tasks aggregate equal texts before anything moves, so a text arrives at its owner at most once a task.
A directory addressed by the leading bits of a 64-bit hash doubles until no bucket is overfull; every bucket
is a key range that one owner task reads in key order, chaining the texts of a colliding hash and comparing
their bytes. The pages that the owners write hold a row for each different text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, UPPER, in_batches, joined_by_key, kept, local_table, n_partitions, rows_of, stored

#: Bytes of different text from which a bucket is split, unless that would make more than MOST_BUCKETS.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 8192
#: Directory bits that a pass over the counts adds at most; fewer where many buckets are overfull, so that it counts no more than 2 * MOST_BUCKETS cells.
STEP = 12
#: Bytes of text that a map task holds while it aggregates.
HELD_BYTES = 24 << 20
ROW = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("sha", pa.string()), ("raw", pa.int64()), ("bytes", pa.int64())])
ENTRY = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("sha", pa.string()), ("norm", pa.binary()), ("keep_id", pa.int64()), ("at_keep", pa.int64()), ("n", pa.int64())])
PAGE = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("chain", pa.int32()), ("sha", pa.string()), ("keep_id", pa.int64()), ("at_keep", pa.int64()), ("group_size", pa.int64())])
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def texts_of(docs: DataFrame, column: str) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col(column), F.lit("")).alias("text"))


def digest(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, key and sha of the normalised text, raw (XXH64 of the text as it is) and bytes, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                norm = text.translate(ASCII_LOWER)
                rows.append((doc, signed(xxh64_intdigest(norm, 42)), sha256(norm).hexdigest(), signed(xxh64_intdigest(text, 42)), len(norm)))
            yield batch_of(rows, ROW)

    return in_batches(texts_of(docs, column), run, "doc_id bigint, key bigint, sha string, raw bigint, bytes bigint")


def merge(entry: list, doc: int | None, at_keep: int, n: int) -> None:
    """Adds n rows, of which at_keep have the largest key doc, to an entry's [keep_id, at_keep, n]; a null key is below any other."""
    new, old = (doc is not None, doc or 0), (entry[0] is not None, entry[0] or 0)
    entry[1] = at_keep + (entry[1] if new == old else 0) if new >= old else entry[1]
    entry[0] = doc if new > old else entry[0]
    entry[2] += n


def preaggregated(docs: DataFrame, column: str, starts: np.ndarray) -> DataFrame:
    """Different texts of each map task with their counts and buckets; a task flushes what it holds when that grows too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes = np.array([xxh64_intdigest(norm, 42) for norm in held], np.uint64)
            buckets = (np.searchsorted(starts, hashes, "right") - 1).tolist()
            rows = [(bucket, key, sha256(norm).hexdigest(), norm, *e) for bucket, key, (norm, e) in zip(buckets, hashes.view(np.int64).tolist(), held.items())]
            for at in range(0, len(rows), 500):
                yield batch_of(rows[at : at + 500], ENTRY)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                norm = text.translate(ASCII_LOWER)
                if (entry := held.get(norm)) is None:  # the dictionary compares the texts themselves
                    if size > HELD_BYTES:
                        yield from flush()
                        held, size = {}, 0
                    held[norm] = [doc, 1, 1]
                    size += len(norm) + 200
                else:
                    merge(entry, doc, 1, 1)
        yield from flush()

    return in_batches(texts_of(docs, column), run, "bucket bigint, key bigint, sha string, norm binary, keep_id bigint, at_keep bigint, n bigint")


def prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("bigint")


def directory(sizes: DataFrame, capacity: int = BUCKET_BYTES) -> dict[tuple[int, int], int]:
    """Buckets as {(depth, prefix): bytes}, from the table (key, bytes) of different keys.

    Starts as one bucket; an overfull one is split by its next bit, doubling the directory when its depth
    reaches the directory's. A pass counts the bytes below every overfull bucket for some next bits, and splits
    are decided on these counts; the next pass takes what is still overfull. With a capacity of a share of all
    bytes, no more than that many buckets are ever overfull, so the counts that reach the driver are as bounded
    as the directory. A bucket of one key is never split.
    """
    spark, buckets, over, depth, step = sizes.sparkSession, {}, [0], 0, STEP
    while over and depth < 60:
        deeper = min(60, depth + step)
        counts = sizes
        if depth:
            hot = local_table(spark, [(p,) for p in over], up=pa.int64())
            counts = sizes.join(F.broadcast(hot), prefix(F.col("key"), depth) == F.col("up"), "left_semi")
        below = defaultdict(list)
        for r in counts.groupBy(prefix(F.col("key"), deeper).alias("p")).agg(F.sum("bytes").alias("b"), (F.min("key") == F.max("key")).alias("one")).collect():
            below[r["p"] >> deeper - depth].append((r["p"], r["b"], r["one"]))
        todo = [(depth, p, below[p]) for p in over]
        over = []
        while todo:
            d, p, rows = todo.pop()
            total = sum(r[1] for r in rows)
            if total <= capacity or len(rows) == 1 and rows[0][2]:
                buckets[d, p] = total
            elif d == deeper:
                over.append(p)
            else:
                for child in (2 * p, 2 * p + 1):
                    todo.append((d + 1, child, [r for r in rows if r[0] >> deeper - d - 1 == child]))
        depth = deeper
        step = max(1, min(STEP, (2 * MOST_BUCKETS // max(1, len(over))).bit_length() - 1))
    return buckets | {(depth, p): 0 for p in over}


def bucket_starts(buckets: dict[tuple[int, int], int]) -> np.ndarray:
    """Where each bucket's range of keys begins, as unsigned numbers in order; a bucket's number is its place."""
    return np.array(sorted(p << 64 - d for d, p in buckets), np.uint64)


def index_pages(docs: DataFrame, rows: DataFrame, column: str = "text", capacity: int | None = None) -> DataFrame:
    """A row for each different normalised text of docs, whose digest is rows: the written pages of the index."""
    spark = docs.sparkSession
    sizes = rows.groupBy("key").agg(F.max("bytes").alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    buckets = directory(sizes, capacity or max(BUCKET_BYTES, total // MOST_BUCKETS))
    owned = preaggregated(docs, column, bucket_starts(buckets)).repartition(n_partitions(spark), "bucket").sortWithinPartitions("bucket", "key")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain = None, []  # the key being read, and [norm, sha, [keep_id, at_keep, n]] of its different texts
        for batch in batches:
            out = []
            for bucket, key, sha, norm, doc, at_keep, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "sha", "norm", "keep_id", "at_keep", "n"))):
                if at != (bucket, key):
                    out += [(*at, k, x[1], *x[2]) for k, x in enumerate(chain)]
                    at, chain = (bucket, key), []
                for x in chain:
                    if x[0] == norm:
                        merge(x[2], doc, at_keep, n)
                        break
                else:
                    chain.append([norm, sha, [doc, at_keep, n]])
            yield batch_of(out, PAGE)
        yield batch_of([(*at, k, x[1], *x[2]) for k, x in enumerate(chain)], PAGE)

    return stored(in_batches(owned, own, "bucket bigint, key bigint, chain int, sha string, keep_id bigint, at_keep bigint, group_size bigint"), "pages")


def decided(docs: DataFrame, column: str = "text") -> DataFrame:
    """The digest of every row with keep_id, group_size and kept."""
    rows = stored(digest(docs, column).withColumn("row", F.monotonically_increasing_id()), "digests")
    pages = index_pages(docs, rows, column).select("key", "sha", "keep_id", "at_keep", "group_size")
    joined = joined_by_key(rows, pages, ["key", "sha"], "group_size", rows.count()).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if pages.where("at_keep > 1").isEmpty():
        return joined
    tied = F.col("kept") & (F.col("at_keep") > 1)
    first = joined.where(tied).groupBy("key", "sha").agg(F.min("row").alias("first")).select("first")
    one = joined.where(tied).join(first, F.col("row") == F.col("first"), "left").withColumn("kept", F.col("first").isNotNull()).drop("first")
    return joined.where(~tied).unionByName(one)


def exact_groups(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest
    doc_id stays; null keys are below any other, and of rows that share the kept key any one stays. Long texts
    are hashed and compared whole. An empty table gives no rows. Other columns are not read.
    """
    return decided(docs, column).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs without the rows whose normalised text equals that of a kept one; columns as they are, whatever their names.

    Decided as by exact_groups: null texts are empty, the largest doc_id stays, null keys only where there is no
    other; of rows with one key and text any one stays. An empty table stays empty.
    """
    return rows_of(docs, decided(docs, column).where("kept").select("doc_id", "raw"), column)
