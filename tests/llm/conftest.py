import pytest
from pyspark.sql import types as T

LONG = "Lorem ipsum dolor sit amet, " * 4000 + "\nthe end of a long document"
LINE = "A line that several documents repeat in full"

# Nulls, empty, long, repeated rows, and columns whose names the operators use themselves.
ROWS = [
    (1, "Alpha beta gamma delta epsilon\n" + LINE, "en", "s"),
    (2, "Alpha beta gamma delta epsilon\n" + LINE, "en", "s"),
    (3, LINE.upper() + "  \nzeta eta theta", None, None),
    (4, "", "en", "s"),
    (5, None, "en", "s"),
    (6, LONG, "fr", "s"),
    (7, "   \t\n\x0b", None, "s"),
    (8, "Zoë naïve façade 😀   x", "fr", "s"),
    (9, "one", "fr", "s"),
    (9, "one", "fr", "s"),
    (None, "no key here", "en", None),
    (10, "12345 !!! ???", "en", "s"),
]
EXTRA = ("_key", "_text", "lanes", "line", "score", "shard", "u", "v", "h", "block", "kept", "ids", "label", "_fp")


def frame(spark, rows):
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
         T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in EXTRA]
    )
    made = [(i, t, lang, source, None if t is None else len(t), *("x" for _ in EXTRA)) for i, t, lang, source in rows]
    return spark.createDataFrame(made, schema)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def rows():
    return ROWS
