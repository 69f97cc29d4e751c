"""SimHash near-duplicates held to the exact Jaccard similarity of their sets of shingles.

Fingerprints of the shingles, linked on the segment-popcount grids of ``simhash``, propose pairs, which are verified
exactly.  Sets of a similarity of 0.8 differ in 10 bits of 64 on average, more than any grid can bear; the links that
fingerprints do not show come from an exact set-similarity join, of texts that no link has brought together before.

Shingles are ordered, those frequent in a sample last; any one order gives the same links.  Two sets of at least
``LIKE`` share one of the first n - ceil(LIKE n) + 1 shingles of either (prefix), are of like size (length), have enough
shingles left after the first in common (position), and differ in few bits of parity.  What remains is compared exactly.
Along with the pairs of the grids, every text meets its neighbour in each cell of a shared shingle; then only texts that are
not yet in one component meet.
"""

from __future__ import annotations

import math
import sys
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import simhash
from palimpsest.llm.shared import batches_of, drop, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, LIKE, DISTANCE = 5, Fraction(4, 5), 3
#: Texts read for the order of the shingles: a share of all, at least and at most so many; and the most frequent shingles it
#: holds.  They decide speed only.
SHARE, SAMPLED, RANKED = 1 / 12, (2_000, 200_000), 200_000
#: First shingles of a set by which it is seen whether two sets have met before.
LEAD = 8
#: Least bits of a set's wide parity (a power of two, at least twice the set's size), and neighbours of a text that the first round looks at.
PARITY, FIRST = 512, 4
#: Pairs of sets that are compared at once, and texts that are handed to Python at once.
PAIRS, TEXTS = 512, 2048
#: Bits of the filter through which the sets to compare are read; what it lets through is joined exactly.
FILTER = 26
#: Bits of the filter that come together to the driver, as one row.
PIECE = 16


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(np.array(simhash.shingle_hashes(text, words), np.uint64))


def set_key(shingles: np.ndarray) -> int:
    """The signed 64-bit key of a set; 0 of the empty set."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), simhash.SEED)).astype(np.int64)) if len(shingles) else 0


def fingerprint(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp, the key of the shingle set, of every row of ``docs(doc_id, text)``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_key(shingle_set(t, words)) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each class of shingles, whether it has an odd number; a power of two of classes, PARITY or twice the set's size
    at least.  Sets differ in at least as many shingles as bits."""
    classes = max(PARITY, 1 << (2 * len(shingles)).bit_length())
    return np.packbits(np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (classes - 1), minlength=classes) & 1)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parity of fewer classes, in bytes: classes that fall together add up."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of ``docs(text)`` repeats, ascending, and their ranks, from 1, the most frequent last."""

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view("<i8"))], ["h"])

    count = docs.count()
    share = min(1.0, min(max(SHARE * count, SAMPLED[0]), SAMPLED[1]) / max(1, count))
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))
    got = some.mapInArrow(run, "h bigint").groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(RANKED).toPandas()
    h = got["h"].to_numpy(np.int64).view("<u8")
    at = np.argsort(h)
    return h[at], (len(h) - np.arange(len(h)))[at]


def digests(docs: DataFrame, words: int, like: Fraction) -> DataFrame:
    """doc_id, fp, sim (the SimHash fingerprint), n (shingles), parity, wide and full (parity of PARITY and of all classes) and
    prefix (shingles in order) of every row of ``docs(doc_id, text)``."""
    order = docs.sparkSession.sparkContext.broadcast(frequent(docs, words))

    def run(batches):
        hot, rank = order.value
        for b in batches:
            keys, sims, sizes, parities, wide, full, prefixes = [], [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                every = np.array(simhash.shingle_hashes(t, words), np.uint64)
                h = np.unique(every)
                n = len(h)
                sims.append(int(simhash.majority([every])[0].astype(np.int64)))
                keys.append(set_key(h))
                sizes.append(n)
                parities.append(int(np.bitwise_xor.reduce(np.uint64(1) << (h >> np.uint64(58)), initial=np.uint64(0)).astype(np.int64)))
                bits = parity(h)
                wide.append(folded(bits, PARITY // 8).view("<i8"))
                full.append(bits.tobytes())
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    h = h[np.argsort(np.where(hot[at] == h, rank[at], 0), kind="stable")]
                prefixes.append(h[: n - math.ceil(like * n) + 1].view("<i8"))
            prefix = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(np.concatenate([*prefixes, np.zeros(0, "<i8")])))
            longs = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * (PARITY // 64), pa.int32()), pa.array(np.concatenate([*wide, np.zeros(0, "<i8")])))
            columns = [b.column(0), *(pa.array(c, pa.int64()) for c in (keys, sims, sizes, parities)), longs, pa.array(full, pa.binary()), prefix]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "sim", "n", "parity", "wide", "full", "prefix"])

    return docs.mapInArrow(run, "doc_id bigint, fp bigint, sim bigint, n bigint, parity bigint, wide array<bigint>, full binary, prefix array<bigint>")


def may_link(x: str, y: str, like: Fraction) -> Column:
    """Whether structs of (n, parity, at) that share a shingle can be of sets of at least ``like``, by length, position and parity.
    True for at least one shared shingle, the first, of sets that are."""
    p, q = like.numerator, like.denominator
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    # In the first cell that both share, none of the shingles before is common.
    left = F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at"))
    differ = F.bit_count(F.col(f"{x}.parity").bitwiseXOR(F.col(f"{y}.parity")))
    return (F.least(n, m) * q >= F.greatest(n, m) * p) & (left * (p + q) >= (n + m) * p) & (differ * (p + q) <= (n + m) * (q - p))


def widely(x: str, y: str, like: Fraction) -> Column:
    """Whether structs of (n, wide) can be of sets of at least ``like``, by the bits of their wide parity."""
    differ = sum(F.bit_count(F.col(f"{x}.wide")[k].bitwiseXOR(F.col(f"{y}.wide")[k])) for k in range(PARITY // 64))
    return differ * (like.numerator + like.denominator) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (like.denominator - like.numerator)


def read_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """fp and shingles of the sets of ``docs(text)`` with a key in ``wanted(fp)``."""

    def packed(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PIECE, bool)
        bits[t.column("s").to_numpy() & ((1 << PIECE) - 1)] = True
        return pa.table([t.column("part").slice(0, 1), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

    slots = wanted.select(F.shiftrightunsigned("fp", 64 - FILTER).alias("s")).distinct().withColumn("part", F.shiftright("s", PIECE))
    filled = np.zeros((1 << (FILTER - PIECE), 1 << (PIECE - 3)), np.uint8)
    for r in slots.groupBy("part").applyInArrow(packed, "part bigint, bits binary").collect():  # no more than the filter itself
        filled[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(filled.ravel())

    def run(batches):
        seen = held.value
        for b in batches:
            keys, sets = [], []
            for t in b.column(0).to_pylist():
                h = shingle_set(t, words)
                k = set_key(h)
                s = (k & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER)
                if seen[s >> 3] >> (7 - (s & 7)) & 1:
                    keys.append(k)
                    sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["fp", "shingles"])

    found = docs.select("text").mapInArrow(run, "fp bigint, shingles binary")
    with batches_of(docs.sparkSession, TEXTS):
        return written(found.join(wanted.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]), "sets")


def alike(a: np.ndarray, b: np.ndarray, like: Fraction) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * like.denominator >= like.numerator * (len(a) + len(b) - common)


def narrowed(pairs: DataFrame, one: DataFrame, like: Fraction) -> DataFrame:
    """Those of ``pairs(a, b)`` that can be alike by the parities of ``one(fp, n, wide, full)``, the short one first."""
    side = lambda k, key: one.select(F.col("fp").alias(key), F.struct("n", "wide").alias(k))
    pairs = pairs.join(side("x", "a"), "a").join(side("y", "b"), "b").filter(widely("x", "y", like)).select("a", "b")

    def run(batches):
        for batch in batches:
            keep = []
            for n, s, t in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                size = min(len(s), len(t))
                x, y = (folded(np.frombuffer(v, np.uint8), size) for v in (s, t))
                differ = int(np.bitwise_count(x ^ y).sum())
                keep.append(differ * (like.numerator + like.denominator) <= n * (like.denominator - like.numerator))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    left = one.select(F.col("fp").alias("a"), F.col("n").alias("n1"), F.col("full").alias("x"))
    right = one.select(F.col("fp").alias("b"), F.col("n").alias("n2"), F.col("full").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("n1") + F.col("n2")).alias("n"), "x", "y").mapInArrow(run, "a bigint, b bigint")


def verified(docs: DataFrame, pairs: DataFrame, words: int, like: Fraction) -> DataFrame:
    """Those of the written table ``pairs(a, b)`` of keys of ``docs`` whose sets have a Jaccard similarity of at least ``like``."""

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(s.as_buffer(), "<u8") for s in batch.column(k)] for k in (2, 3))
            keep = pa.array([alike(s, t, like) for s, t in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    sets = read_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("fp")), words)
    left, right = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    with batches_of(docs.sparkSession, PAIRS):
        out = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "alike")
    drop(sets, pairs)
    return out


def proposed(found: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints the grids link, and of one key and each other with the same fingerprint."""
    of = found.filter("n > 0").select("fp", "sim").distinct()
    first = of.groupBy("sim").agg(F.min("fp").alias("first"))
    near = simhash.links(first.select(F.col("sim").alias("fp")), distance)
    ends = lambda k: first.select(F.col("sim").alias(k), F.col("first").alias(f"{k}_first"))
    linked = near.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_first").alias("x"), F.col("b_first").alias("y"))
    same = of.join(first, "sim").filter("fp <> first").select(F.col("first").alias("x"), F.col("fp").alias("y"))
    return linked.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def links(docs: DataFrame, found: DataFrame, distance: int, words: int, like: Fraction) -> DataFrame:
    """Edges (a, b) that connect every two keys of ``found``, the digests of ``docs``, whose sets are alike, directly or through others."""
    one = written(found.filter("n > 0").select("fp", "n", "parity", "wide", "full", "prefix").dropDuplicates(["fp"]), "sets_once")
    cells = one.select(F.posexplode("prefix").alias("at", "token"), "fp", "n", "parity").select("token", F.struct("fp", "n", "parity", "at").alias("x"))
    # Neighbours by size, and in an order that is another one in every cell: a large group of near copies hangs together by these.
    cell = Window.partitionBy("token")
    sized, dealt = cell.orderBy("x.n", "x.fp"), cell.orderBy(F.xxhash64("token", "x.fp"), "x.fp")
    cells = cells.withColumn("y", F.lag("x").over(sized)).withColumn("z", F.lead("x").over(sized)).withColumn("w", F.lag("x").over(dealt))
    shared = written(cells.filter("y is not null or z is not null").select("token", "x", "y", "w"), "cells")
    pair = [F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")]
    beside = shared.select("x", F.explode(F.array("y", "w")).alias("y")).filter("y is not null").filter(may_link("x", "y", like)).select(*pair).distinct()
    beside = narrowed(beside, one, like).withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("b"))).filter(F.col("k") <= FIRST).drop("k")
    near = verified(docs, written(beside.unionByName(narrowed(proposed(found, distance), one, like)).distinct(), "beside"), words, like)
    label = simhash.components(near)
    cells = shared.select("token", "x", F.col("x.fp").alias("node")).join(label, "node", "left").select("token", "x", F.coalesce("label", "node").alias("label"))
    counts = cells.groupBy("token", "label").count().groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1")
    mixed = written(cells.join(counts.select("token", "most"), "token").withColumn("node", F.col("x.fp")).join(one.select(F.col("fp").alias("node"), "wide", F.slice("prefix", 1, LEAD).alias("lead")), "node"), "mixed")
    # Of a cell's largest component, no two members need meet; any other pair has a member outside it.
    met_by = mixed.select("token", "label", "most", F.col("x").withField("lead", F.col("lead")).withField("wide", F.col("wide")).alias("x"))
    rest = met_by.filter("label <> most").select("token", F.col("x").alias("y"), F.col("label").alias("other"))
    # Two sets meet in the first cell of their leading shingles that they share; those that share none of these, in every cell.
    common = F.array_intersect("x.lead", "y.lead")
    met = met_by.join(rest.hint("merge"), "token").filter((F.col("label") != F.col("other")) & may_link("x", "y", like) & widely("x", "y", like) & F.coalesce(F.get(common, 0) == F.col("token"), F.lit(True)))
    far = verified(docs, written(narrowed(met.select(*pair).distinct(), one, like), "met"), words, like)
    out = written(near.unionByName(far), "links")
    drop(one, shared, near, mixed, far)
    return out


def near_copies(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS, like: Fraction = LIKE) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hexadecimal digits of the set's key), component_id.

    component_id is the smallest doc_id reachable through links of similarity ``like`` or more, its own included; null if no
    document reached has a doc_id.  ``distance`` is that of the fingerprints that propose pairs and decides no link.  A text
    of under ``words`` words is one shingle; null, empty and wordless texts are alike; rows that repeat share a component;
    texts of any length are read whole; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    with batches_of(docs.sparkSession, TEXTS):
        found = written(digests(docs, words, like), "digests")
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = links(docs, found, distance, words, like)
    label = simhash.components(edges)
    linked = nodes.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    of = linked.join(lowest, "label").select("fp", "component_id")
    out = found.select("doc_id", "fp").join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    drop(edges)
    return out
