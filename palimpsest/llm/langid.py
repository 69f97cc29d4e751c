"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the character n-grams, of one to three characters, that both
have.  Landmark texts give a Nyström map of the kernel, and one-versus-rest ridge regression on it a score a language.
Presence is a 0/1 vector over hashed n-grams, so the kernel with all landmarks, the map and the regression are products
of matrices; the last two and the landmarks' own vectors are multiplied once and a batch of texts is scored by one product.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Hashed n-grams; a power of two.
DIM = 1 << 14
ORDERS = (1, 2, 3)
#: Texts scored by one product.
BATCH = 256
UNDETERMINED = "und"


def presence(texts: list[str | None]) -> np.ndarray:
    """0/1 rows of hashed n-gram presence over whole texts; a row of zeros where there is no letter."""
    rows = np.zeros((len(texts), DIM), np.float32)
    for i, text in enumerate(texts):
        c = _letters(text or "")
        if not len(c):
            continue
        gram = np.zeros(len(c), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(c) < n:
                break
            gram = (gram[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(29)
            if n in ORDERS:
                rows[i, (gram >> np.uint64(50)).astype(np.int64)] = 1.0
    return rows


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with a space before, after and in place of every run of other characters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    low = c < 0x250
    letter = np.where(low, LATIN[np.where(low, c, 0)], True)
    if not low.all():
        wide = c[~low]
        kinds, back = np.unique(wide, return_inverse=True)
        letter[~low] = np.array([chr(k).isalpha() for k in kinds.tolist()], bool)[back]
    if not letter.any():
        return np.zeros(0, np.uint64)
    c = np.where(letter, c, 32)
    keep = np.ones(len(c), bool)
    keep[1:] = letter[1:] | letter[:-1]
    c = c[keep]
    c = c[int(c[0] == 32) : len(c) - int(c[-1] == 32)]
    return np.concatenate([[32], c, [32]]).astype(np.uint64)


LATIN = np.array([chr(k).isalpha() for k in range(0x250)], bool)


class Model:
    """languages (sorted) and the DIM x languages matrix that takes presence rows to scores."""

    def __init__(self, languages: list[str], matrix: np.ndarray, bias: np.ndarray):
        self.languages, self.matrix, self.bias = languages, matrix.astype(np.float32), bias

    def decide(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Decision values, a column a language, and the number of n-grams of each text."""
        rows = presence(texts)
        size = rows.sum(axis=1)
        return rows @ self.matrix / np.sqrt(np.maximum(size, 1))[:, None] + self.bias, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of the greatest decision value, the first in order among equal ones, and its share of all."""
        names, scores = [], []
        for k in range(0, len(texts), BATCH):
            z, size = self.decide(texts[k : k + BATCH])
            e = np.exp(4 * (z - z.max(axis=1, keepdims=True))) if z.shape[1] else z
            for row, p, n in zip(z, e, size):
                known = n > 0 and len(self.languages) > 0
                names.append(self.languages[int(row.argmax())] if known else UNDETERMINED)
                scores.append(float(p.max() / p.sum()) if known else 0.0)
        return names, scores


def fit(texts: list[str], languages: list[str], landmarks: int = 200, ridge: float = 1e-2, seed: int = 5) -> Model:
    """A model of texts in memory."""
    return fit_rows(presence(texts), languages, landmarks, ridge, seed)


def fit_rows(rows: np.ndarray, languages: list[str], landmarks: int = 200, ridge: float = 1e-2, seed: int = 5) -> Model:
    """Nyström landmarks are drawn alike from every language; ridge regression of 0/1 targets on the mapped kernel."""
    names = sorted(set(languages))
    size = np.array([np.count_nonzero(r) for r in rows])
    used = size > 0
    rows, size, y = rows[used], size[used], np.array([names.index(v) for v in languages], int)[used]
    if not len(rows):
        return Model([], np.zeros((DIM, 0)), np.zeros(0))
    names, y = [names[k] for k in np.unique(y)], np.unique(y, return_inverse=True)[1]
    draw = np.random.default_rng(seed)
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([draw.permutation(np.flatnonzero(y == k))[:each] for k in range(len(names))])
    marks = rows[chosen].astype(np.float32) / np.sqrt(size[chosen])[:, None].astype(np.float32)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # the Nyström map takes kernel rows to features
    kernel = np.concatenate([rows[k : k + BATCH].astype(np.float32) @ marks.T for k in range(0, len(rows), BATCH)]) / np.sqrt(size)[:, None]
    x = kernel.astype(np.float64) @ root
    target = np.eye(len(names))[y]
    weight = np.sqrt(1.0 / np.bincount(y, minlength=len(names))[y])[:, None]  # languages count alike
    one = np.column_stack([x, np.ones(len(x))]) * weight
    w = np.linalg.solve(one.T @ one + ridge * np.eye(one.shape[1]), one.T @ (target * weight))
    return Model(names, marks.T.astype(np.float64) @ root @ w[:-1], w[-1])


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, most: int = 3000) -> Model:
    """Learn from at most about ``most`` rows of ``docs(doc_id, text, lang)`` that are not held out, chosen by a hash of
    doc_id alike from every language, all of them; null texts, ids and languages are left out.  The bound covers training
    alone; only one row a language, and the chosen rows' n-grams, reach the driver."""
    usable = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string")).filter("doc_id is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    # One row a language.
    per = usable.groupBy("lang").agg(F.count("*").alias("_n"))
    many = per.count()
    if not many:
        return Model([], np.zeros((DIM, 0)), np.zeros(0))
    each = max(1, most // many)
    share = F.least(F.lit(1 << 20), F.ceil(F.lit(each << 20) / F.col("_n")))

    def start(batches):  # whole texts are seen by the kernel in the worker; only rows of presence leave it
        for b in batches:
            for k in range(0, b.num_rows, BATCH):
                part = b.slice(k, BATCH)
                rows = presence(part.column(0).to_pylist())
                packed = [x.tobytes() for x in np.packbits(rows > 0, axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), part.column(1)], ["bits", "lang"])

    chosen = usable.join(F.broadcast(per), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < share).filter("text is not null").select("text", "lang")
    got = chosen.mapInArrow(start, "bits binary, lang string").toPandas()
    got = got.sort_values(["lang", "bits"], kind="stable")
    rows = np.array([np.unpackbits(np.frombuffer(b, np.uint8)) for b in got["bits"]], np.uint8).reshape(len(got), -1)
    return fit_rows(rows, got["lang"].tolist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1); ``und`` and 0 where the text is null or has no letter.

    Columns that are called so already are replaced, all others are kept; whole texts of any length are read; rows that
    repeat have equal results; an empty table gives no rows.
    """

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        names, scores = model.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    found = "_".join(["palimpsest", *docs.columns])  # no column of docs is called that
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn(found, of(F.col("text").cast("string"))).select(*kept, F.col(f"`{found}`.lang_pred"), F.col(f"`{found}`.score"))


def languages(docs: DataFrame, most: int = 3000) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, lang)``: doc_id, held_out, lang_pred, score.

    Learned from rows that are not held out (crc32 of doc_id as text mod 4 is 2); null doc_ids are not held out; without
    any row to learn from every text is ``und``; other columns are ignored, whole texts of any length are read, rows that
    repeat have equal results, ties go to the first language in order; an empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return identify(base, train(docs, most)).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
