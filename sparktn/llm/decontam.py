"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask hashes the words at some places of a window and ignores the others, so a changed word spoils only the
windows in which it is looked at. Hashes of documents and of benchmark items are joined; a hit fixes how the
two texts are aligned, and a verification counts equal words over the aligned item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, small, stored

#: Words over which a verified overlap is measured (the item's if fewer), the share that must be equal, and words below which all must be.
WINDOW, SHARE, EXACT = 13, 0.8, 8
#: Places that the masks of an item look at, by its words (13 and more alike). Whichever words of a verified overlap are
#: changed within the share allowed, one of the masks has a placement that looks at none of them.
MASKS = {
    13: ((0, 1, 3, 6, 7, 9), (0, 2, 3, 4, 8, 10), (0, 1, 4, 6, 7, 10)),
    12: ((0, 1, 3, 6, 7, 9), (0, 2, 3, 4, 8, 10), (0, 1, 2, 4, 5, 6), (0, 1, 2, 3, 4, 5)),
    11: ((0, 1, 3, 6, 7, 9), (0, 2, 3, 4, 8, 10), (0, 3, 4, 5, 7, 8), (0, 1, 2, 3, 5, 8)),
    10: ((0, 1, 2, 3, 5, 6), (0, 1, 4, 5, 6, 7), (0, 1, 2, 4, 8, 9), (0, 1, 3, 5, 7, 9), (0, 2, 3, 5, 6, 7)),
    9: ((0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 5, 6)),
    8: ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 5, 6)),
} | {n: (tuple(range(n)),) for n in range(1, EXACT)}
#: Rows of benchmark hashes up to which they are sent to all tasks; more are joined by a shuffle.
SENT = 500_000
#: Words of items that a row verifies; a document with more hits is verified in several rows.
ASKED = 100_000


# Arrays are exploded with _outer: for a plain explode, Spark filters by the array's size below the projections
# that make it, so words would be split anew for every window. Joins drop the nulls.


def hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def seeds(words: Column, mask: tuple[int, ...], number: int) -> Column:
    n = F.size(words) - mask[-1]
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(number), *(words[i + o] for o in mask)))


def overlaps(docs: DataFrame, benchmark: DataFrame, column: str = "text", item_column: str = "text") -> DataFrame:
    """doc_id, raw (XXH64 of the text), item_id, equal and n: verified overlaps of documents with items."""
    items = benchmark.select("item_id", hashes(F.col(item_column)).alias("b")).where("size(b) > 0")
    sizes = sorted(r[0] for r in items.select(F.least(F.size("b"), F.lit(WINDOW))).distinct().collect()) or [WINDOW]
    masks = list(dict.fromkeys(m for n in sizes for m in MASKS[n]))
    texts = items.groupBy("b").agg(F.min("item_id").alias("first"))  # equal items are searched once
    posted = [texts.where(F.least(F.size("b"), F.lit(WINDOW)).isin([n for n in sizes if m in MASKS[n]])).select("first", F.size("b").alias("m"), F.posexplode_outer(seeds(F.col("b"), m, k)).alias("ipos", "seed")) for k, m in enumerate(masks)]
    index = posted[0]
    for p in posted[1:]:
        index = index.unionByName(p)
    index = small(index.distinct(), SENT)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(column), F.lit(""))).alias("raw"), hashes(F.col(column)).alias("h"))
    offsets = sorted({o for m in masks for o in m})
    # The words at all the masks' places side by side, so that generated code hashes them, not an interpreted lambda.
    beside = F.arrays_zip(*(F.slice("h", o + 1, F.size("h")).alias(f"w{o}") for o in offsets))
    rows = rows.select("doc_id", "raw", F.posexplode_outer(beside).alias("at", "w"))
    seen = [F.when(F.col(f"w.w{m[-1]}").isNotNull(), F.xxhash64(F.lit(k), *(F.col(f"w.w{o}") for o in m))) for k, m in enumerate(masks)]
    hits = rows.select("doc_id", "raw", "at", F.explode_outer(F.array(*seen)).alias("seed")).join(index, "seed")
    found = hits.select("doc_id", "raw", "first", "m", (F.col("at") - F.col("ipos")).alias("diag")).distinct()
    words = F.sum("m").over(Window.partitionBy("doc_id", "raw").orderBy("first", "diag"))
    asked = found.withColumn("part", F.floor(words / ASKED)).groupBy("doc_id", "raw", "part").agg(F.collect_list(F.struct("first", "m", "diag")).alias("asked")).drop("part").withColumnsRenamed({"doc_id": "__doc", "raw": "__raw"})
    asked = stored(asked, "hits")
    held = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(column), F.lit(""))).alias("raw"), F.col(column).alias("text"))
    met = held.join(small(asked, 100_000, 32 * F.size("asked")), held["doc_id"].eqNullSafe(F.col("__doc")) & (held["raw"] == F.col("__raw")))
    met = met.select("doc_id", "raw", hashes(F.col("text")).alias("h"), "asked")
    cut = F.transform("asked", lambda a: F.struct(a["first"].alias("first"), F.greatest(-a["diag"], F.lit(0)).alias("skip"), F.slice(F.col("h"), F.greatest(a["diag"], F.lit(0)) + 1, F.greatest(a["m"] - F.greatest(-a["diag"], F.lit(0)), F.lit(0))).alias("d")))
    aligned = met.select("doc_id", "raw", F.explode_outer(cut).alias("a")).select("doc_id", "raw", F.col("a.first").alias("first"), F.col("a.skip").alias("skip"), F.col("a.d").alias("d"))
    aligned = aligned.join(small(texts, 50_000, 8 * F.size("b")), "first")
    aligned = aligned.select("doc_id", "raw", "first", F.size("b").alias("m"), F.zip_with("d", F.slice(F.col("b"), F.col("skip") + 1, F.size("d")), lambda x, y: (x == y).cast("int")).alias("same"))
    w = F.least(F.col("m"), F.lit(WINDOW))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("same") - w), lambda i: F.aggregate(F.slice(F.col("same"), i + 1, w), F.lit(0), lambda a, x: a + x)))
    need = F.when(w < EXACT, w).otherwise(F.ceil(w * SHARE))
    sure = aligned.where(F.size("same") >= w).select("doc_id", "raw", "first", best.alias("equal"), w.alias("n"), need.alias("need")).where("equal >= need").drop("need")
    named = items.join(texts, "b").select("item_id", F.col("first").alias("__first"))
    return sure.groupBy("doc_id", "raw", "first").agg(F.max("equal").alias("equal"), F.max("n").alias("n")).join(named, F.col("first") == F.col("__first")).select("doc_id", "raw", "item_id", "equal", "n")


def contaminated(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, share for every row.

    Null texts and texts without words never overlap; an empty benchmark marks nothing; items without words
    are passed over. Rows that repeat a key and text get the same answer; long texts are searched whole, equally
    good overlaps all count. An empty table gives no rows.
    """
    found = overlaps(docs, benchmark, column).groupBy("doc_id", "raw").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("equal") / F.col("n")).alias("share")).withColumnsRenamed({"doc_id": "__doc", "raw": "__raw"})
    keys = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(column), F.lit(""))).alias("raw"))
    joined = keys.join(found, keys["doc_id"].eqNullSafe(F.col("__doc")) & (keys["raw"] == F.col("__raw")), "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """docs without the rows that overlap a benchmark item; columns as they are, whatever their names.

    Rows with null, empty or wordless texts stay; rows that repeat a key and text stay or go together. An empty
    table stays empty, and an empty benchmark removes nothing.
    """
    found = stored(overlaps(docs, benchmark, column).select("doc_id", "raw").distinct(), "overlaps")
    return rows_of(docs, found, column, kept=False)
