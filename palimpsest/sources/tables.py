"""Relations read from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.model import DELETE, PUT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log over ``events``: a version an event, keyed by user, an error deletes."""
    gone = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("k"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(gone, DELETE).otherwise(PUT).alias("op"),
        F.when(gone, "").otherwise(F.concat_ws(":", "event_type", "props")).alias("v"),
    )


def entry_term(event_id: Column) -> Column:
    return (F.floor(event_id / 2500) + 1).cast("bigint")


def replicated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, term, op, k, v): the change log as a log of terms of 2500 entries."""
    log = change_log(spark, sf_dir)
    return log.select(F.col("seq").alias("idx"), entry_term(F.col("seq") - 1).alias("term"), "op", "k", "v")


def ordered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide ordered key space: order keys as text."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k")).distinct()


def hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of varied length for hashing."""
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7919).cast("string").alias("k")).distinct()
