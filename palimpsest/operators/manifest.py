"""The manifest: version edits and what they fold to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALARS = ("log", "prev_log", "next_file", "last_seq")


def live_files(edits: DataFrame) -> DataFrame:
    """Files added and not deleted later, as (lvl, num)."""
    adds = edits.filter(F.col("kind") == "add").select("level", "number", "edit_no")
    gone = edits.filter(F.col("kind") == "delete").groupBy("level", "number").agg(F.max("edit_no").alias("gone"))
    kept = adds.join(gone, (adds["level"] == gone["level"]) & (adds["number"] == gone["number"]) & (gone["gone"] >= adds["edit_no"]), "left_anti")
    return kept.select(F.col("level").cast("bigint").alias("lvl"), F.col("number").alias("num")).distinct()


def counters(edits: DataFrame) -> DataFrame:
    """The newest value of each scalar, one row; ``last_seq`` never falls."""
    of = lambda kind: F.max_by("number", F.when(F.col("kind") == kind, F.col("edit_no")))
    picked = [of(k).alias(k) for k in SCALARS[:3]]
    return edits.agg(*picked, F.max(F.when(F.col("kind") == "last_seq", F.col("number"))).alias("last_seq"))


def logs_to_replay(logs: DataFrame, edits: DataFrame) -> DataFrame:
    """Logs at or after the manifest's log number, in order; without an edit all of them."""
    least = counters(edits).select(F.coalesce("log", F.lit(0)).alias("least"))
    return logs.crossJoin(F.broadcast(least)).withColumn("replay", F.col("log_number") >= F.col("least")).select("log_number", "replay").orderBy("log_number")


def levels(edits: DataFrame) -> DataFrame:
    """Per level: live files and their bytes."""
    sizes = edits.filter(F.col("kind") == "add").select(F.col("level").cast("bigint").alias("lvl"), F.col("number").alias("num"), "file_size", "edit_no")
    sizes = sizes.groupBy("lvl", "num").agg(F.max_by("file_size", "edit_no").alias("file_size"))  # a number added again counts as added last
    return live_files(edits).join(sizes, ["lvl", "num"]).groupBy("lvl").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
