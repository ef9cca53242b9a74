"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII letters, the only ones that the normalised text of deduplication lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER = re.compile(r"[^\W\d_]")


#: Bytes of the rows that a worker gets at once.
BATCH_BYTES = 4 << 20
#: What a worker process keeps from task to task: one helper at a time, so that stages don't add up.
KEPT: dict[object, object] = {}


def kept(key: object = None, make=lambda: None):
    """The worker's helper of this key, made anew if it last had another; without a key, the last one is freed."""
    if key not in KEPT:
        KEPT.clear()
        pa.default_memory_pool().release_unused()
        KEPT[key] = make()
    return KEPT[key]


def in_batches(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow(run, schema) with batches of BATCH_BYTES, or 10,000 narrow rows, unless the session has a bound of its own.

    Spark's is 64 MB: of whole texts that is held for each task by Java's Arrow buffers, by Python's, and as strings.
    Spark reads it when the plan is made, so the session keeps it.
    """
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, BATCH_BYTES)
    return rows.mapInArrow(run, schema)


def local_table(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A table of a few rows from the driver, as a local relation: of a list Spark makes an RDD, for which each executor starts Python workers of another kind."""
    return spark.createDataFrame(pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(types.items())}))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local session gets a temporary folder; on a cluster, which shares none, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparktn-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def fold(c: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as empty text."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(n)).cast("int")


def small(df: DataFrame, rows: int, weight: Column | None = None, most: int = 64 << 20) -> DataFrame:
    """df with a broadcast hint only if it is proved to have at most so many rows, and bytes where their weight is given."""
    if weight is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    got = df.agg(F.count("*").alias("n"), F.sum(weight.cast("bigint")).alias("b")).first()
    return F.broadcast(df) if got["n"] <= rows and (got["b"] or 0) <= most else df


def spare(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has, in any case of letters."""
    used, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def joined_by_key(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows with the columns of keyed, which has each of their keys once and the number n of rows that it has, of `total`.

    Keys with more rows than a quarter of a task's share are at most four a task, so these are broadcast; the
    others are dealt by key. Keys must not be null.
    """
    cap = max(1, total // (4 * n_partitions(rows.sparkSession)))
    hot = F.broadcast(keyed.where(F.col(n) > cap))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(keyed.where(F.col(n) <= cap), on))


def marked(docs: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, not null, that stand for doc_id and text, and their names."""
    names = spare(docs.columns, "key_id", "key_none", "key_raw")
    values = F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.xxhash64(F.coalesce(F.col(column), F.lit("")))
    return docs.withColumns(dict(zip(names, values))), names


def rows_of(docs: DataFrame, keys: DataFrame, column: str = "text", kept: bool = True) -> DataFrame:
    """The rows of docs whose doc_id and raw (XXH64 of the text) are in keys, one for each; or, not kept, all others, as they are.

    One shuffle of docs: rows that repeat doc_id and text, of which any one stays, meet where the keys are joined.
    """
    own, names = marked(docs, column)
    other = keys.select(F.coalesce("doc_id", F.lit(0)).alias(names[0]), F.col("doc_id").isNull().alias(names[1]), F.col("raw").alias(names[2]))
    if kept:
        return own.join(other, names, "left_semi").dropDuplicates(names).select(*docs.columns)
    return own.join(small(other, 200_000), names, "left_anti").select(*docs.columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, n_folds: int, held_out: int, rows: int, chars: int) -> list[tuple[str, int]]:
    """At most `rows` training texts of each class with their labels, for fitting on the driver.

    Bounded by parameters: whole texts of at most `chars` characters, chosen by the order of a hash of
    the key, so the sample is the same at any partitioning. Rows whose fold is held_out are never used. Of
    several texts with one key the least counts, of several labels the greater.
    """
    keyed = docs.select("doc_id", F.col("text")).where(F.col("text").isNotNull() & (F.length("text") <= chars) & (fold(F.col("doc_id"), n_folds) != held_out))
    known = labels.select("doc_id", F.col(target).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.where(fold(F.col("doc_id"), n_folds) != held_out).join(keyed.select("doc_id").distinct(), "doc_id", "left_semi")
    tops = [chosen.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (1, 0)]
    picked = tops[0].unionByName(tops[1])
    one = keyed.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return [(r["text"], r["y"]) for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def platt(f: np.ndarray, y: np.ndarray, steps: int = 500) -> tuple[float, float]:
    """Slope and offset of a logistic fit of y to the decision values f, each class with equal weight."""
    a, b = 1.0, 0.0
    n1 = max(1, int(y.sum()))
    w = np.where(y == 1, 0.5 / n1, 0.5 / max(1, len(y) - n1))
    scale = max(float(np.abs(f).max(initial=0.0)), 1e-9)
    x = f / scale
    for _ in range(steps):
        p = sigmoid(a * x + b)
        g, h = w * (p - y), w * p * (1 - p)
        ga, gb = float((g * x).sum()) + 1e-4 * a, float(g.sum())
        haa, hab, hbb = float((h * x * x).sum()) + 1e-4, float((h * x).sum()), float(h.sum()) + 1e-6
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det * 0.5, b - (haa * gb - hab * ga) / det * 0.5
    return a / scale, b
