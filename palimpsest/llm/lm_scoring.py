"""Cross-entropy difference: how much better a target model predicts a text than a background model does, per token.

Tokens are words and runs of punctuation marks.  Both models are class-based bigram models of one form over one vocabulary, that of the whole corpus: a
word follows with the probability of its class after the class of the word before, times that of the word in its class.
The CLASSES most frequent words are a class each, all others are one; probabilities are smoothed towards the classes' and
words' shares, and these towards equal shares, so they add up to 1 after any word.  The target model counts the target
documents, the background model all documents, scaled down to the target's size: matched models smooth alike.  What a
document itself adds to a model is taken off before the model scores it.

Counts cover the whole corpus and grow with it.  A bounded number of frequent words travel to every worker; the others,
each of them rare, are joined by hash.  Any number of them gives the same scores.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.decontaminate import Hasher
from palimpsest.llm.shared import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words that are a class of their own, and words whose counts travel to every worker (16 bytes each).
CLASSES, HEAD = 256, 1 << 18
#: Weight of the class shares, in counts of a context; what is added to the count of every word of the vocabulary.
MU, DELTA = 4.0, 0.5
#: Characters worked on at once; words counted before they are passed on.
SPAN, HELD = 1 << 20, 1 << 22
#: Target ids that are broadcast at most (8 bytes each); beyond, they are joined by a shuffle.
TARGETS = 1 << 22


def portions(texts: list[str | None]):
    """Index ranges of about SPAN characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SPAN:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def tallied(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, sorted, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, target, background) over all of ``docs(text, is_target)``: words by hash, and their occurrences."""

    def run(batches):
        hasher, held, flags, size = Hasher(marks=True), [], [], 0

        def made():
            (word,), _ = tallied(np.concatenate(held))
            hashes, flag = np.concatenate(held), np.concatenate(flags)
            at = np.searchsorted(word, hashes)
            n = np.bincount(at, minlength=len(word))
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(at[flag], minlength=len(word)).astype(np.int64)), pa.array(n.astype(np.int64))], ["word", "target", "background"])

        for b in batches:
            texts, wanted = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), bool)
            for i, j in portions(texts):
                h, owner = hasher([t or "" for t in texts[i:j]])
                held.append(h)
                flags.append(wanted[i:j][owner])
                size += len(h)
                if size >= HELD:
                    yield made()
                    held, flags, size = [], [], 0
        if size:
            yield made()

    return docs.mapInArrow(run, "word bigint, target bigint, background bigint").groupBy("word").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


class Head:
    """The frequent words, ascending by hash: class (CLASSES for all that have none of their own) and counts."""

    def __init__(self, word: np.ndarray, counts: np.ndarray, classes: int):
        """``word`` by falling frequency, ``counts`` of target and background in two rows."""
        order = np.argsort(word)
        self.word, self.counts = word[order], counts[:, order].astype(np.float64)
        self.classes = min(classes, len(word))
        self.of = np.minimum(np.arange(len(word)), self.classes)[order]

    def place(self, h: np.ndarray) -> np.ndarray:
        """The place of every hash among the frequent words, -1 of others."""
        if not len(self.word):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return np.where(self.word[at] == h, at, -1)

    def read(self, texts: list[str | None], hasher: Hasher):
        """(hash, text number, place, class, class of the word before) of every word; the class before a text is one more than all."""
        h, owner = hasher([t or "" for t in texts])
        at = self.place(h)
        of = np.where(at >= 0, self.of[at], self.classes) if len(self.word) else np.full(len(h), self.classes)
        before = np.full(len(h), self.classes + 1)
        if len(h):
            before[1:] = np.where(owner[1:] == owner[:-1], of[:-1], self.classes + 1)
        return h, owner, at, of, before


def count_classes(docs: DataFrame, head) -> np.ndarray:
    """Counts of class after class over ``docs(text, is_target)``, by the broadcast ``head``: [target or background, before, class]."""
    k = head.value.classes
    size = (k + 2) * (k + 1)

    def run(batches):
        hasher, counts = Hasher(marks=True), np.zeros((2, size), np.int64)
        for b in batches:
            texts, wanted = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), bool)
            for i, j in portions(texts):
                _, owner, _, of, before = head.value.read(texts[i:j], hasher)
                code = before * (k + 1) + of
                counts[1] += np.bincount(code, minlength=size)
                counts[0] += np.bincount(code[wanted[i:j][owner]], minlength=size)
        at = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], ["code", "target", "background"])

    got = docs.mapInArrow(run, "code int, target bigint, background bigint").groupBy("code").agg(F.sum("target").alias("target"), F.sum("background").alias("background")).toPandas()
    out = np.zeros((2, size))
    out[0, got["code"]], out[1, got["code"]] = got["target"], got["background"]
    return out.reshape(2, k + 2, k + 1)


class Models:
    """The target and the background model but for the rare words: counts of classes, vocabulary size and scale."""

    def __init__(self, head: Head, pairs: np.ndarray, vocabulary: int):
        self.head, self.pairs, self.vocabulary = head, pairs, vocabulary
        self.after, self.words = pairs.sum(axis=2), pairs.sum(axis=1)
        self.total = self.words.sum(axis=1)
        #: The background counts as much as the target.
        self.scale = (1.0, self.total[0] / max(1.0, self.total[1]))
        k = head.classes
        #: Equal share of every word of the vocabulary, and of the unknown word; that of the classes.
        self.equal, self.alpha = 1.0 / (vocabulary + 1), DELTA * (vocabulary + 1)
        self.shares = np.append(np.full(k, self.equal), (vocabulary + 1 - k) * self.equal)

    def rare(self, m: int, own_class: np.ndarray) -> np.ndarray:
        """Scaled count of the class of all other words, smoothed: what a rare word's smoothed count is divided by."""
        return (self.words[m, -1] - own_class) * self.scale[m] + self.alpha * self.shares[-1]


def losses(texts: list[str | None], targets: np.ndarray, models: Models, hasher: Hasher):
    """(number of words; sums of losses under target and background but for rare words within their class; what rare words'
    counts are divided by in either; text number, hash and occurrences of the rare words of each text)."""
    head, k, n = models.head, models.head.classes, len(texts)
    h, owner, at, of, before = head.read(texts, hasher)
    size = np.bincount(owner, minlength=n)
    (doc, a, c), times = tallied(owner, before, of)
    row = doc * (k + 2) + a
    own_after = np.bincount(row, weights=times, minlength=n * (k + 2))[row]
    class_times = np.bincount(doc * (k + 1) + c, weights=times, minlength=n * (k + 1))
    (who, word), many = tallied(owner, h)
    place = head.place(word)
    inner = (place < 0) | (head.of[place] == k) if len(head.word) else np.ones(len(word), bool)
    out, below = np.zeros((2, n)), np.zeros((2, n))
    for m in (0, 1):
        counted = np.ones(n) if m else targets.astype(float)  # the model has counted this text itself
        scale, total = models.scale[m], (models.total[m] - size * counted) * models.scale[m] + models.alpha
        share = ((models.words[m][c] - class_times[doc * (k + 1) + c] * counted[doc]) * scale + models.alpha * models.shares[c]) / total[doc]
        p = ((models.pairs[m][a, c] - times * counted[doc]) * scale + MU * share) / ((models.after[m][a] - own_after * counted[doc]) * scale + MU)
        out[m] = np.bincount(doc, weights=-times * np.log(p), minlength=n)
        below[m] = models.rare(m, class_times.reshape(n, k + 1)[:, k] * counted)
        known = inner & (place >= 0)
        q = ((head.counts[m][place[known]] - many[known] * counted[who[known]]) * scale + DELTA) / below[m][who[known]]
        out[m] += np.bincount(who[known], weights=-many[known] * np.log(q), minlength=n)
    left = place < 0
    return size, out, below, who[left], word[left], many[left]


def score(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_tokens, target_loss, background_loss (mean nats a token) and
    score, their difference: above 0 where the text is likelier as one of ``targets(doc_id)`` than as one of all documents.

    Tokens are runs of letters and digits and of other marks, as they are written, as hashes of 64 bits.  Null and empty texts have 0 tokens, losses and
    score.  doc_ids that repeat or are null in ``targets`` count once or not at all; rows that repeat in ``docs`` are counted
    each, and each takes off its own words alone; without targets all scores are 0.  Texts of any length are read whole; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    wanted = targets.select(F.col("doc_id").cast("bigint")).filter("doc_id is not null").distinct().withColumn("is_target", F.lit(True))
    side = F.broadcast(wanted) if wanted.count() <= TARGETS else wanted.hint("merge")
    flagged = base.join(side, "doc_id", "left").select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    counts = written(count_words(flagged.select("text", "is_target")), "words")
    # Words by bands of frequency, a few hundred rows; the frequent words are the bands that hold HEAD words together at most.
    band = F.floor(16 * F.log2("background")).cast("int")
    bands = counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).orderBy(F.desc("band")).collect()
    vocabulary, least, held = sum(r.n for r in bands), 1 << 20, 0
    for r in bands:
        held += r.n
        if held > HEAD:
            break
        least = r.band
    top = counts.filter(band >= least).toPandas().sort_values(["background", "word"], ascending=[False, True])
    head = spark.sparkContext.broadcast(Head(top["word"].to_numpy(np.int64).view(np.uint64), np.array([top["target"], top["background"]]).reshape(2, -1), CLASSES))
    models = spark.sparkContext.broadcast(Models(head.value, count_classes(flagged.select("text", "is_target"), head), vocabulary))

    def run(batches):
        hasher, row = Hasher(marks=True), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts, flags = (batch.column(k).to_pylist() for k in range(3))
            for i, j in portions(texts):
                size, loss, below, who, word, many = losses(texts[i:j], np.array(flags[i:j], bool), models.value, hasher)
                ends = np.append(0, np.cumsum(np.bincount(who, minlength=j - i))).astype(np.int32)
                columns = [
                    pa.array(np.arange(row, row + j - i)), pa.array(ids[i:j], pa.int64()), pa.array(flags[i:j]), pa.array(size.astype(np.int64)), pa.array(loss[0]), pa.array(loss[1]), pa.array(below[0]), pa.array(below[1]),
                    pa.ListArray.from_arrays(ends, pa.array(word.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(many.astype(np.int64))),
                ]
                row += j - i
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "is_target", "n", "t", "b", "t_below", "b_below", "words", "times"])

    parts = written(flagged.mapInArrow(run, "row bigint, doc_id bigint, is_target boolean, n bigint, t double, b double, t_below double, b_below double, words array<bigint>, times array<bigint>"), "losses")
    scale = models.value.scale[1]
    words = parts.select("row", "is_target", "t_below", "b_below", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "is_target", "t_below", "b_below", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    own = F.when(F.col("is_target"), F.col("times")).otherwise(0)
    t = -F.col("times") * F.log((F.col("target") - own + DELTA) / F.col("t_below"))
    b = -F.col("times") * F.log(((F.col("background") - F.col("times")) * scale + DELTA) / F.col("b_below"))
    sums = words.join(counts.filter(band < least), "word").groupBy("row").agg(F.sum(t).alias("t_rare"), F.sum(b).alias("b_rare"))
    per = F.greatest(F.col("n"), F.lit(1))
    loss = lambda k: ((F.col(k) + F.coalesce(f"{k}_rare", F.lit(0.0))) / per).alias({"t": "target_loss", "b": "background_loss"}[k])
    out = parts.select("row", "doc_id", "n", "t", "b").join(sums, "row", "left").select("doc_id", F.col("n").alias("n_tokens"), loss("t"), loss("b"))
    return out.withColumn("score", F.col("background_loss") - F.col("target_loss"))
