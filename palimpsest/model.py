"""The data model: one append-only relation of versioned operations, and the relations derived from it."""

from __future__ import annotations

from pyspark.sql import types as T

#: Operation kinds of a version.
DELETE, PUT = 0, 1

#: One row a version.  ``op`` alone decides deletion: an empty value is a value.
CHANGE_LOG = T.StructType([
    T.StructField("k", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.IntegerType(), False),
    T.StructField("v", T.StringType(), True),
])

#: One row an entry of a version edit: the scalars ``log``, ``prev_log``, ``next_file``, ``last_seq``, and files added or deleted.
MANIFEST_EDIT = T.StructType([
    T.StructField("edit_no", T.LongType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("level", T.IntegerType(), True),
    T.StructField("number", T.LongType(), True),
    T.StructField("file_size", T.LongType(), True),
    T.StructField("smallest", T.StringType(), True),
    T.StructField("largest", T.StringType(), True),
])

#: One row a replicated log entry; indices start at 1.
REPLICATED_LOG = T.StructType([
    T.StructField("idx", T.LongType(), False),
    T.StructField("term", T.LongType(), False),
    T.StructField("op", T.IntegerType(), False),
    T.StructField("k", T.StringType(), False),
    T.StructField("v", T.StringType(), True),
])

# Fixed values of the storage format.
BATCH_HEADER = 12
FRAME_HEADER = 4
RESTART_INTERVAL = 16
BLOCK_SIZE = 4096
GROUP_COMMIT_BYTES = 1 << 20
COMPACTION_TRIGGER = 4
FILTER_GRANULE_BITS = 11
CACHE_SHARD_BITS = 4
ARENA_BLOCK = 4096


class StoreError(Exception):
    """Base of the errors a store raises."""


class NotFound(StoreError):
    pass


class Corruption(StoreError):
    pass


class InvalidArgument(StoreError):
    pass
