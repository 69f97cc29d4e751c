"""Benchmark decontamination by spaced seeds.

Words are hashed.  A mask is a fixed pattern over a window of words that looks at some and ignores the others, so a changed
word leaves the hashes of the masks that ignore it alone.  The masks of a window cover every choice of as many changed
words as the thresholds allow, so no overlap that meets them is lost.  Hashes of benchmark windows and of document windows
are matched; around each hit the document and the item are compared word by word along their whole common diagonal;
stretches where enough words agree count, changed words or not.

A benchmark of up to BLOCK bytes is held in memory, and one pass over the documents matches and verifies.  A larger one is a
table: documents pass a Bloom filter of bounded size, what passes is joined by hash, and pairs are verified; again one pass.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a window, and how many of them must agree for the stretch to count.  Items of fewer words are one window: of 4
#: words or more all but one must agree, of fewer all.
SPAN, AGREE = 8, 6
EDGE = SPAN - AGREE
#: Masks over SPAN words: any two words are ignored by one of them, as each ignores two of the four couples (k, k + 4).
MASKS = ((0, 1, 4, 5), (0, 2, 4, 6), (0, 3, 4, 7), (1, 2, 5, 6), (1, 3, 5, 7), (2, 3, 6, 7))
#: A document is contaminated by an item if so many words agree, or this share of the item's.
LEAST, SHARE = 12, 0.6
#: Bytes of benchmark text that are held in memory, and characters of document text worked on at once.
BLOCK, TOGETHER = 16 << 20, 1 << 20
#: Places of one seed in a text times those in an item, up to which their differences are listed; beyond, they are convolved.
LISTED = 1 << 14
#: Differences listed at once.
CHUNK = 1 << 20
#: Most bits of the Bloom filter (32 MB), its bits for every benchmark window, and its probes.
FILTER, PER, PROBES = 28, 32, 8
SIEVE_BITS = 20
ROOT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PUNCTUATION = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]+")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of words: runs of ASCII letters and digits and of characters beyond ASCII, lower-cased, without punctuation;
    with ``marks``, in their own case and with punctuation, and also of runs of other ASCII characters but spaces."""

    def __init__(self, marks: bool = False):
        self.marks = marks
        draw = np.random.default_rng(3)
        self.value = draw.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
        self.kind = np.array([1 if b >= 128 or chr(b).isalnum() else 2 if marks and b > 32 else 0 for b in range(256)], np.uint8)
        self.up, self.down = _powers(ROOT, 0), _powers(INVERSE, 0)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of every word of the texts, in order."""
        raw = []
        for t in texts:
            t = t if self.marks else t.lower()
            raw.append((t if self.marks or t.isascii() else PUNCTUATION.sub(" ", t)).encode("utf-8", "surrogatepass"))
        size = np.array([len(r) + 1 for r in raw])
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        if len(self.up) <= len(data):
            self.up, self.down = _powers(ROOT, 2 * len(data)), _powers(INVERSE, 2 * len(data))
        kind = self.kind[data]
        turn = np.append(0, np.flatnonzero(kind[1:] != kind[:-1]) + 1)
        some = kind[turn] > 0  # the last run is a space
        start, end = turn[some], turn[1:][some[:-1]]
        total = np.cumsum(np.where(kind > 0, self.value[data], np.uint64(0)) * self.up[: len(data)])
        before = np.where(start > 0, total[start - 1], np.uint64(0))
        h = (total[end - 1] - before) * self.down[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h, np.searchsorted(np.cumsum(size), start, side="right")


def masks_of(n: int) -> tuple[int, tuple]:
    """(span, masks) of an item of ``n`` words: masks such that any words that may differ are ignored by one."""
    if n >= SPAN:
        return SPAN, MASKS
    if n < 4:
        return n, (tuple(range(n)),) if n else ()
    return n, tuple(tuple(k for k in range(n) if k != left) for left in range(n))


def agree(n: int) -> int:
    """Words that must agree in a window of an item of ``n`` words."""
    return AGREE if n >= SPAN else n if n < 4 else n - 1


def meets(matched: int, n: int) -> bool:
    return matched >= LEAST or matched >= SHARE * n and matched >= min(4, agree(n)) and n > 0


def seeds(h: np.ndarray, mask: tuple, span: int, salt: int = 0) -> np.ndarray:
    """The hash of the window that begins at each word."""
    n = max(0, len(h) - span + 1)
    out = np.full(n, np.uint64(salt * 1_000_003 + 7))
    for at in mask:
        out = (out + h[at : at + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * at)
        out ^= out >> np.uint64(29)
    return out


def kinds(sizes) -> list[tuple[int, int, tuple]]:
    """(salt, span, mask) for every mask that items of these numbers of words need."""
    out = []
    for n in sorted({min(int(n), SPAN) for n in sizes if n}):
        span, masks = masks_of(n)
        out += [(16 * n + k, span, m) for k, m in enumerate(masks)]
    return out


def windows(h: np.ndarray, owner: np.ndarray, kind: tuple, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, begins) of the windows that lie within one text; with ``size``, only of items which this mask is for."""
    salt, span, mask = kind
    s = seeds(h, mask, span, salt)
    at = np.flatnonzero(owner[: len(s)] == owner[span - 1 : span - 1 + len(s)]) if len(s) else np.zeros(0, np.int64)
    if size is not None:
        at = at[np.minimum(size[owner[at]], SPAN) == span]
    return s[at], at


def padded(h: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``texts`` texts with EDGE words that agree with none before and after each: windows may hang over."""
    out = np.zeros(len(h) + 2 * EDGE * texts, np.uint64)
    out[np.arange(len(h)) + EDGE * (2 * owner + 1)] = h
    return out, np.repeat(np.arange(texts), np.bincount(owner, minlength=texts) + 2 * EDGE)


def differences(places: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The distinct differences of two ascending lists of places, in memory proportional to their spans."""
    if len(places) * len(others) <= LISTED:
        return np.unique(places[:, None] - others[None, :])
    a, b = places - places[0], others[-1] - others[::-1]
    n = 1 << int(a[-1] + b[-1] + 1).bit_length()
    x, y = np.zeros(n, np.float32), np.zeros(n, np.float32)
    x[a], y[b] = 1, 1
    return np.flatnonzero(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), n) > 0.5) + places[0] - others[-1]


class Benchmark:
    """Items in memory: their words, and the sorted hashes of their windows under each mask."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids = ids
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.words = np.concatenate([*words, np.zeros(0, np.uint64)])
        self.owner = np.repeat(np.arange(len(words)), self.size)
        self.kinds = kinds(self.size)
        self.tables = []
        for kind in self.kinds:
            s, at = windows(self.words, self.owner, kind, self.size)
            order = np.argsort(s, kind="stable")
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[(s >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
            self.tables.append((s[order], at[order], sieve))

    def diagonals(self, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number * items + item, word of the texts at which the item would begin) of every hit, distinct and sorted."""
        keys, begins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def keep(key, begin):
            order = np.lexsort((begin, key))
            key, begin = key[order], begin[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (begin[1:] != begin[:-1])
            keys.append(key[new])
            begins.append(begin[new])

        for kind, (table, at, sieve) in zip(self.kinds, self.tables):
            s, i = windows(h, owner, kind)
            some = sieve[(s >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)]
            s, i = s[some], i[some]
            low, high = np.searchsorted(table, s, "left"), np.searchsorted(table, s, "right")
            some = high > low
            s, i, low, high = s[some], i[some], low[some], high[some]
            if not len(i):
                continue
            order = np.lexsort((i, s, owner[i]))
            s, i, low, many, text = s[order], i[order], low[order], (high - low)[order], owner[i[order]]
            first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (text[1:] != text[:-1])))
            count = np.diff(np.append(first, len(s)))
            group = np.repeat(np.arange(len(first)), count)
            heavy = (count * many[first] > LISTED)[group]
            for g in np.unique(group[heavy]):  # a seed that a text and items repeat
                a, n = first[g], count[g]
                there = at[low[a] : low[a] + many[a]]
                for item in np.unique(self.owner[there]):
                    d = differences(i[a : a + n], there[self.owner[there] == item] - self.start[item])
                    keep(np.full(len(d), text[a] * len(self.ids) + item), d)
            i, low, many = i[~heavy], low[~heavy], many[~heavy]
            ends = np.cumsum(many)
            cut = 0
            while cut < len(i):
                to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + CHUNK)))
                x, m = slice(cut, to), many[cut:to]
                k = np.repeat(low[x] - np.append(0, np.cumsum(m)[:-1]), m) + np.arange(m.sum())
                here, j = np.repeat(i[x], m), at[k]
                item = self.owner[j]
                keep(owner[here] * len(self.ids) + item, here - j + self.start[item])
                cut = to
        if len(keys) > 2:
            keys, begins = [np.concatenate(keys)], [np.concatenate(begins)]
            keep(keys[0], begins[0])
        return keys[-1], begins[-1]

    def matches(self, h: np.ndarray, owner: np.ndarray, texts: int) -> list[tuple]:
        """(text number, item number, agreeing words) of every text and item that meet the thresholds."""
        h, owner = padded(h, owner, texts)
        first = np.searchsorted(owner, np.arange(texts + 1))
        key, begin = self.diagonals(h, owner)
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
        out = []
        for a, z in zip(cuts, np.append(cuts[1:], len(key)).astype(int)):
            text, item = divmod(int(key[a]), len(self.ids))
            n, at = int(self.size[item]), int(self.start[item])
            span, least = min(SPAN, n), agree(n)
            covered = np.zeros(n, bool)
            for b in begin[a:z].tolist():
                low, high = max(b, int(first[text])), min(b + n, int(first[text + 1]))
                same = np.zeros(n, bool)
                same[low - b : high - b] = h[low:high] == self.words[at + low - b : at + high - b]
                run = np.append(0, np.cumsum(same))
                good = np.flatnonzero(run[span:] - run[:-span] >= least)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, good, 1)
                np.add.at(edge, good + span, -1)
                covered |= same & (np.cumsum(edge)[:n] > 0)
                if covered.all():
                    break
            if meets(int(covered.sum()), n):
                out.append((text, item, int(covered.sum())))
        return out

    def overlaps(self, texts: list[str], hasher: Hasher) -> list[tuple]:
        """(text number, item id, agreeing words, words of the item) of every text and item that meet the thresholds."""
        return [(t, self.ids[i], m, int(self.size[i])) for t, i, m in self.matches(*hasher(texts), len(texts))]


def _portions(texts: list[str | None]):
    """Index ranges of about TOGETHER characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= TOGETHER:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id, matched_words, item_words, share) of ``docs(doc_id, text)`` and ``benchmark(item_id, text)``.

    A pair is there if at least LEAST words of the item, or SHARE of them, agree in stretches of SPAN words of which AGREE
    or more are the same; items of 4 to 7 words if all words but one agree in a row, items of 1 to 3 if all do.  Null texts
    are empty and match nothing, as items without words do; rows that repeat on either side give rows that repeat, null
    ids are kept, texts of any length are compared whole, other columns are ignored; empty tables give no rows.
    """
    base = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = _held(docs.sparkSession, benchmark)
    if held is None:
        return _joined(base, benchmark)
    names = ["doc_id", "item_id", "matched_words", "item_words", "share"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())

    def run(batches):
        hasher = Hasher()
        for b in batches:
            ids, texts, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i, j in _portions(texts):
                rows += [(ids[i + t], item, m, n, m / n) for t, item, m, n in held.value.overlaps(texts[i:j], hasher)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)

    return base.mapInArrow(run, PAIR)


PAIR = "doc_id bigint, item_id bigint, matched_words bigint, item_words bigint, share double"


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _held(spark: SparkSession, benchmark: DataFrame):
    """A broadcast of the benchmark, if its text has no more than BLOCK bytes."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > BLOCK:
        return None
    rows = items.collect()
    h, owner = Hasher()([r.text for r in rows])
    return spark.sparkContext.broadcast(Benchmark([r.item_id for r in rows], np.split(h, np.searchsorted(owner, np.arange(1, len(rows))))))


def _hashed(df: DataFrame) -> DataFrame:
    """``df(id, text)`` as (id, words), words being the hashes of the text's words; texts without words drop out."""

    def run(batches):
        hasher = Hasher()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _portions(texts):
                h, owner = hasher(texts[i:j])
                parts = np.split(h, np.searchsorted(owner, np.arange(1, j - i)))
                keep = [k for k, p in enumerate(parts) if len(p)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i + k] for k in keep], pa.int64()), pa.array([parts[k].tobytes() for k in keep], pa.binary())], ["id", "words"])

    return df.mapInArrow(run, "id bigint, words binary")


def _filter(spark: SparkSession, table: DataFrame, count: int):
    """A broadcast Bloom filter, at most 2^FILTER bits, of the seeds of ``table(seed)``."""
    bits = min(FILTER, max(16, (PER * count).bit_length()))
    piece = 1 << 16

    def run(batches):
        held = np.zeros(1 << bits, bool)
        for b in batches:
            s = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(PROBES):
                held[probe(s, k, bits)] = True
        packed = np.packbits(held).reshape(-1, min(piece, 1 << bits) // 8)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([packed[k].tobytes() for k in some], pa.binary())], ["part", "bits"])

    def either(t: pa.Table) -> pa.Table:
        held = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        return pa.table([t.column("part").slice(0, 1), pa.array([held.tobytes()], pa.binary())], names=["part", "bits"])

    got = table.select("seed").mapInArrow(run, "part int, bits binary").groupBy("part").applyInArrow(either, "part int, bits binary").collect()
    out = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, min(piece, 1 << bits) // 8)
    for r in got:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast((bits, out.ravel()))


def probe(s: np.ndarray, k: int, bits: int) -> np.ndarray:
    mixed = (s ^ np.uint64(k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _joined(base: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``overlaps`` for a benchmark of any size."""
    spark = base.sparkSession
    # Items of the same words are one item here; their ids come back at the end.
    hashed = _hashed(_items(benchmark).withColumnRenamed("item_id", "id")).withColumn("item", F.sha2("words", 256))
    hashed = written(hashed, "benchmark")
    items = written(hashed.select("item", "words").dropDuplicates(["item"]), "items")
    sizes = items.select(F.least(F.octet_length("words") / 8, F.lit(SPAN)).cast("int").alias("n")).distinct().collect()
    used = kinds([r.n for r in sizes])

    def windowed(batches):
        for b in batches:
            for item, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.frombuffer(w, np.uint64)
                owner, size = np.zeros(len(h), np.int64), np.array([len(h)])
                s = np.unique(np.concatenate([windows(h, owner, k, size)[0] for k in used]))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(s), pa.string()), pa.array(s.view(np.int64))], ["item", "seed"])

    table = written(items.mapInArrow(windowed, "item string, seed bigint"), "seeds")
    held = _filter(spark, table.select("seed"), table.count())

    def passing(batches):
        hasher, task, row = Hasher(), TaskContext.get().partitionId(), 0
        bits, filled = held.value
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _portions(texts):
                h, owner = hasher(texts[i:j])
                wide, of = padded(h, owner, j - i)
                found, where = [], []
                for kind in used:
                    s, at = windows(wide, of, kind)
                    for k in range(PROBES):
                        slot = probe(s, k, bits)
                        some = (filled[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
                        s, at = s[some], at[some]
                    found.append(s)
                    where.append(of[at])
                found, where = np.concatenate([*found, np.zeros(0, np.uint64)]), np.concatenate([*where, np.zeros(0, np.int64)])
                rows = []
                for t in np.unique(where).tolist():
                    row += 1
                    lo, hi = np.searchsorted(owner, [t, t + 1])
                    rows.append((task << 40 | row, ids[i + t], h[lo:hi].tobytes(), np.unique(found[where == t]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], ["row", "doc_id", "words", "seeds"])

    hits = written(base.mapInArrow(passing, "row bigint, doc_id bigint, words binary, seeds array<bigint>"), "hits")
    pairs = hits.select("row", F.explode("seeds").alias("seed")).join(table, "seed").select("row", "item").distinct()
    both = pairs.join(hits.select("row", "doc_id", "words"), "row").join(items.withColumnRenamed("words", "those"), "item")

    def verified(batches):
        for b in batches:
            out = []
            for doc, item, w, v in zip(*(b.column(k).to_pylist() for k in range(4))):
                h, one = np.frombuffer(w, np.uint64), np.frombuffer(v, np.uint64)
                out += [(doc, item, m, len(one), m / len(one)) for _, _, m in Benchmark([0], [one]).matches(h, np.zeros(len(h), np.int64), 1)]
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], ["doc_id", "item", "matched_words", "item_words", "share"])

    found = both.select("doc_id", "item", "words", "those").mapInArrow(verified, PAIR.replace("item_id bigint", "item string"))
    return found.join(hashed.select("item", F.col("id").alias("item_id")), "item").select("doc_id", "item_id", "matched_words", "item_words", "share")


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, name: str = "contaminated") -> DataFrame:
    """``docs`` with a boolean column ``name``: whether ``overlaps`` has a pair of that row's text.

    Rows keep all their columns; one that is called ``name`` already is replaced.  Null and empty texts are not contaminated.
    """
    held = _held(docs.sparkSession, benchmark)
    if held is None:
        key = "_".join(["palimpsest", *docs.columns])  # no column of docs is called that
        whole = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
        leaks = overlaps(whole.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct().withColumn(f"{key}_", F.lit(True))
        out = whole.join(leaks, key, "left").withColumn(name, F.coalesce(F.col(f"{key}_"), F.lit(False)))
        return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], F.col(f"`{name}`"))

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        hasher, values = Hasher(), [t or "" for t in texts]
        out = np.zeros(len(values), bool)
        for i, j in _portions(values):
            out[[i + t for t, *_ in held.value.overlaps(values[i:j], hasher)]] = True
        return pd.Series(out)

    return docs.withColumn(name, hit(F.col("text").cast("string")))
