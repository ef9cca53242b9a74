"""Tables that are written to the shared folder between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, a local session gets a temporary folder and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparktn-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors.

    With by, a column of few values, a filter on it reads only the files of the values that it asks for.
    """
    path = shared_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def bucketed(df: DataFrame, name: str, by: str, n: int, sort: list[str]) -> tuple[DataFrame, str]:
    """df written to the shared folder in n buckets of a column, and the name of its table: grouping by the column moves no rows.

    Dropping the table leaves the files.
    """
    path = shared_path(df.sparkSession, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(n, by).sortBy(*sort).option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table), table
