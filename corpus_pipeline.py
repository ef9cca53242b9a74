"""A training corpus from the table of documents: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparktn.llm import decontam, exact_dedup, packing, simhash, toxicity
from sparktn.llm.common import stored, table
from sparktn.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic.

    Null and empty texts have no token and are scored as such; rows that repeat a text stay or go together; without
    labels of both classes, and of an empty table, every row stays. Other columns are kept whatever their names.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id.

    Null counts as empty text; null keys stay only where a group has no other; of rows with one key and text any one
    stays. An empty table stays empty. Other columns are kept whatever their names.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more), the one with the smallest doc_id.

    Candidates come from the hierarchical index of SimHash fingerprints, and from bands of minima for what 64 bits can't tell.
    Null, empty and wordless texts are equal; null keys stay only where a group has no other; long texts are compared
    whole. An empty table stays empty. Other columns are kept whatever their names.
    """
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null, empty and wordless texts stay; rows that repeat a key and text stay or go together; an empty benchmark
    removes nothing. An empty table stays empty. Other columns are kept whatever their names.
    """
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left and their places in sequences.

    Null and empty texts are one piece that holds the end id; long ones are cut; equal rows may swap places. An empty
    table gives no rows.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: The first stage is a trained kernel machine, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
