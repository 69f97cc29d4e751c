"""The corpus pipeline: five stages from ``documents`` to packed sequences.

Every stage reads all that its predecessor kept, whole texts of any length.  The first four return the columns of
``documents``; the last returns the pieces of the packed sequences.  Other columns of the input are ignored, whatever
their names; an empty table passes through every stage as one.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, langid, near_copies, packing, simhash, toxicity
from palimpsest.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language is taken as identified from this score on (0 to 1; with four languages chance is 0.25).
SURE = 0.3


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score below 0.5; learns from the labelled rows that are not held out.

    Null and empty texts score as texts without hits, and stay; rows that repeat stay or go together; null columns count for nothing.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.sample(docs, labels, toxicity.held_out, 8000))
    return _documents(toxicity.score(docs, model, name="_toxicity").filter("_toxicity < 0.5"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified: some letters, and a score of at least SURE.

    Null and empty texts have no letters and go; rows that repeat stay or go together; null languages teach nothing; of
    languages that score alike the first in order is taken, which decides nothing here.
    """
    model = langid.train(docs)
    return _documents(langid.identify(docs.withColumnRenamed("lang", "lang_given"), model).filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= SURE)).withColumnRenamed("lang_given", "lang"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near copies (five-word shingles, Jaccard similarity of 0.8 or more) the document of the
    smallest doc_id, one row of it; of documents of null doc_id that link to none with one, one row for each fingerprint.

    Null, empty and wordless texts are near copies of each other; rows that share a doc_id are one document, of which one row stays.
    """
    docs = _documents(docs)
    found = written(simhash.near_duplicates(docs, words=5, like=Fraction(4, 5)), "near")
    kept = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    rows = docs.join(kept, "doc_id")
    out = rows.filter("_rows = 1")
    if not kept.filter("_rows > 1").isEmpty():  # ids that repeat; the texts of all others are not shuffled again
        out = out.unionByName(rows.filter("_rows > 1").dropDuplicates(["doc_id"]))
    out = _documents(out)
    lonely = found.filter("component_id is null").select("fingerprint").distinct()
    return out if lonely.isEmpty() else out.unionByName(_nameless(docs.filter("doc_id is null"), lonely))


def _nameless(docs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """One document without doc_id for each of the fingerprints."""
    one = written(docs.dropDuplicates(["text"]).withColumn("_key", F.xxhash64("text")), "nameless")
    prints = near_copies.fingerprint(one.select(F.col("_key").alias("doc_id"), "text"))
    named = prints.select(F.col("doc_id").alias("_key"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")).dropDuplicates(["_key"])
    return _documents(one.join(named, "_key").join(fingerprints, "fingerprint", "left_semi").dropDuplicates(["fingerprint"]))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap with a benchmark item.

    Null and empty texts overlap with none; rows that repeat stay or go together; items without words, or of null text, match nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(decontaminate.flag_contaminated(docs, benchmark, "_leak").filter("not _leak"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens.

    A null or empty text is its end token alone; rows that repeat, and null doc_ids, are packed each for itself.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Trained models, fingerprints and tokenizers aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
