"""Point, multi-key and ordered access to the live state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.model import PUT
from palimpsest.operators.ordered import key_blocks, previous
from palimpsest.operators.resolve import as_of, latest, newest


def point_get(log: DataFrame, key: str, seq: int | None = None) -> DataFrame:
    """(k, found, deleted, v) of one key, one row whether it exists or not; the key filter reaches the scan."""
    hit = as_of(log.filter(F.col("k") == key), seq).agg(F.max_by(F.struct("op", "v"), F.col("seq")).alias("r"))
    found = F.coalesce(F.col("r.op") == PUT, F.lit(False))
    return hit.select(F.lit(key).alias("k"), found.alias("found"), (F.col("r").isNotNull() & ~found).alias("deleted"), F.when(found, F.col("r.v")).alias("v"))


def multi_get(log: DataFrame, wanted: DataFrame, seq: int | None = None) -> DataFrame:
    """(k, found, v) of every wanted key.  Only versions of wanted keys are resolved."""
    keys = wanted.select("k").distinct()
    mine = newest(as_of(log.join(keys, "k", "left_semi"), seq))
    found = F.coalesce(F.col("op") == PUT, F.lit(False))
    return keys.join(mine, "k", "left").select("k", found.alias("found"), F.when(found, F.col("v")).alias("v"))


def range_scan(log: DataFrame, low: str | None = None, high: str | None = None, seq: int | None = None) -> DataFrame:
    """Live rows of low <= k < high in key order; the key bounds are applied before resolution."""
    part = log
    if low is not None:
        part = part.filter(F.col("k") >= low)
    if high is not None:
        part = part.filter(F.col("k") < high)
    return latest(part, seq).orderBy("k")


def lower_bound(log: DataFrame, key: str) -> DataFrame:
    """The least live key >= key, null if none."""
    return latest(log.filter(F.col("k") >= key)).agg(F.min("k").alias("lower"))


def predecessor(log: DataFrame, key: str) -> DataFrame:
    """The greatest live key < key, null if none."""
    return latest(log.filter(F.col("k") < key)).agg(F.max("k").alias("pred"))


def last_key(log: DataFrame) -> DataFrame:
    """The greatest live key."""
    return latest(log).agg(F.max("k").alias("last"))


def known_keys(log: DataFrame, candidates: DataFrame) -> DataFrame:
    """Keys of the log that are among the candidates."""
    return log.select("k").distinct().join(candidates.select("k").distinct(), "k", "left_semi")


def neighbours(log: DataFrame, block: Column | None = None) -> DataFrame:
    """Every live key with the one before and the one after it (a cursor's Prev and Next)."""
    keys = latest(log).select("k")
    block = key_blocks(keys, "k") if block is None else block
    with_prev = previous(keys, block, F.col("k"), F.col("k"), "prev")
    after = with_prev.filter("prev is not null").select(F.col("prev").alias("k"), F.col("k").alias("next"))
    return with_prev.join(after, "k", "left").select("k", "prev", "next")
