import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(6000))
#: Nulls in any column, empty and long texts, ties, repeated rows.
ODD = [
    (1, "One plain line of text that is long enough to count.\nAnother line that nobody repeats, here it is.", "en", "s", 10),
    (2, None, "en", "s", None),
    (3, "", None, None, 0),
    (None, "A text without a number, which is long enough to be a line.", "en", "s", 3),
    (None, None, None, None, None),
    (4, LONG, "en", "s", 1),
    (5, "One plain line of text that is long enough to count.\n\n   \nshort", "en", "s", 10),
    (5, "One plain line of text that is long enough to count.\n\n   \nshort", "en", "s", 10),
    (5, "the same number with another text, also long enough to be a line", "de", "s", 10),
    (6, "123 ... \t\n", "en", "s", 1),
    (7, "ünïcode Straße ÀÉ 日本語 テキスト 🎉 and ASCII", "fr", "s", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Columns named like those that operators make inside."""
    from pyspark.sql import functions as F

    names = ["fp", "key", "s", "u", "w", "lk", "id0", "hash", "removed", "shard", "toxicity", "kept", "size", "lines", "line_no", "root"]
    return odd.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
