"""Order-dependent arithmetic over a whole table without gathering it in one task.

A window without PARTITION BY moves every row to a single task.  Here the order is cut into blocks by a column that grows
with it: each block is windowed by itself and what earlier blocks contribute comes from a table of one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_blocks(df: DataFrame, key: str, rows: int = 20_000, most: int = 1024) -> Column:
    """A block column that grows with ``key``, of about ``rows`` rows a block: cut at quantiles of a sample chosen by a hash of the key."""
    n = df.count()
    blocks = min(most, -(-n // rows))
    if blocks < 2:
        return F.lit(0)
    share = max(1, min(1 << 30, (100 * blocks << 30) // n))
    some = sorted(r[0] for r in df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share).select(key).collect())  # about 100 a block
    cuts = sorted({some[len(some) * k // blocks] for k in range(1, blocks)}) if some else []
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0)


def _carried(df: DataFrame, block: Column, value: Column) -> tuple[DataFrame, DataFrame]:
    rows = df.withColumn("_block", block)
    sums = rows.groupBy("_block").agg(F.sum(value).alias("_sum"))
    # One row a block; the blocks are chosen wide enough for that to be small.
    before = F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum")
    return rows, sums.select("_block", before.alias("_before"))


def running_sum(df: DataFrame, block: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over this row and those before it."""
    rows, before = _carried(df, block, value)
    own = F.sum(value).over(Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(name, own).join(before, "_block").withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_block", "_before")


def row_numbers(df: DataFrame, block: Column, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the place of the row in the order, from 1."""
    rows, before = _carried(df, block, F.lit(1))
    own = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return rows.withColumn(name, own).join(before, "_block").withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_block", "_before")


def previous(df: DataFrame, block: Column, order: Column, value: Column, name: str) -> DataFrame:
    """Add ``name``: ``value`` of the row before, null on the first; ``order`` is a single column."""
    rows = df.withColumn("_block", block)
    last = rows.groupBy("_block").agg(F.max_by(value, order).alias("_last"))
    last = last.select("_block", F.lag("_last").over(Window.orderBy("_block")).alias("_last"))
    within = Window.partitionBy("_block").orderBy(order)
    rows = rows.withColumn(name, F.lag(value).over(within)).withColumn("_first", F.row_number().over(within) == 1)
    return rows.join(last, "_block").withColumn(name, F.when(F.col("_first"), F.col("_last")).otherwise(F.col(name))).drop("_block", "_first", "_last")
