"""Version resolution: the newest version of each key, as of a sequence, with tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import PUT
from palimpsest.operators.ordered import key_blocks, running_sum


def newest(versions: DataFrame, by: str = "seq", *keys: str) -> DataFrame:
    """The row of the greatest ``by`` of each key (default ``k``), deletions included.

    ``max_by`` of a struct aggregates partially before the one shuffle; every map task sends at most a row a key.
    """
    keys = keys or ("k",)
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def as_of(versions: DataFrame, seq: int | None) -> DataFrame:
    """The versions a snapshot sees."""
    return versions if seq is None else versions.filter(F.col("seq") <= seq)


def live(resolved: DataFrame) -> DataFrame:
    """Drop tombstones.  Only after resolution: before it, deleted keys would come back."""
    return resolved.filter(F.col("op") == PUT)


def latest(log: DataFrame, seq: int | None = None) -> DataFrame:
    """Live state (k, v, seq), optionally as of a sequence."""
    return live(newest(as_of(log, seq))).select("k", "v", "seq")


def anti_state(log: DataFrame) -> DataFrame:
    """Live state as puts that no newer version follows; an independent form of ``latest``."""
    last = log.groupBy("k").agg(F.max("seq").alias("last"))
    newer = last.select(F.col("k").alias("nk"), "last")
    return log.filter(F.col("op") == PUT).join(newer, (F.col("k") == F.col("nk")) & (F.col("last") > F.col("seq")), "left_anti").select("k", "v", "seq")


def history(log: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Every version with the sequence that replaces it.

    Windows are over a key and ``width`` sequences, so that a key with a large share of all versions is many windows; the
    last version of each takes the first sequence of the key's next one.
    """
    rows = log.withColumn("_s", F.floor(F.col("seq") / width))
    first = rows.groupBy("k", "_s").agg(F.min("seq").alias("_first"))
    after = first.select("k", "_s", F.lead("_first").over(Window.partitionBy("k").orderBy("_s")).alias("_after"))
    own = F.lead("seq").over(Window.partitionBy("k", "_s").orderBy("seq"))
    return rows.withColumn("_own", own).join(after, ["k", "_s"]).select("k", "seq", "op", "v", F.coalesce("_own", "_after").alias("valid_to"))


def internal_order(log: DataFrame, block: Column | None = None, width: int = 1 << 20) -> DataFrame:
    """O1: position of every version by key, newest first, a put before a deletion of the same sequence.

    Rows are numbered within a key and ``width`` sequences; what comes before is summed over one row for each of those,
    in blocks by ``block``, a column of ``k`` that grows with it.
    """
    rows = log.withColumn("_s", -F.floor(F.col("seq") / width))
    sizes = rows.groupBy("k", "_s").agg(F.count("*").alias("_n"))
    groups = running_sum(sizes, key_blocks(sizes, "k") if block is None else block, [F.col("k"), F.col("_s")], F.col("_n"), "_end")
    own = F.row_number().over(Window.partitionBy("k", "_s").orderBy(F.col("seq").desc(), F.col("op").desc()))
    placed = rows.withColumn("_own", own).join(groups, ["k", "_s"])
    return placed.select((F.col("_end") - F.col("_n") + F.col("_own")).alias("pos"), "k", "seq", "op")
