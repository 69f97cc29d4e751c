import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


LONG = "wörd " * 40_000


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns whose names clash."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 3), (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 3),
        (2, None, None, None, None), (None, "null id text with some words", "en", None, 1), (None, None, None, None, None),
        (3, "", "de", "s", 0), (4, "   \n\t ", "fr", "s", 5), (5, LONG, "de", "s", 7), (6, "1234 5678 !!", "es", "t", 2),
        (7, "a", None, "s", 1), (8, "日本語のテキスト «quoted» <|endoftext|>   ok", "xx", "s", 9), (9, "a  b\n c\td  ", "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {n: F.lit("clash") for n in ("score", "fp", "key", "part", "h", "fingerprint", "label", "held_out", "_block", "found")}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.filter("false")
