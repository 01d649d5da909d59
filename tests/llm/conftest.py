import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("x", T.LongType()),
        T.StructField("node", T.StringType()),
        T.StructField("_text", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("n_words", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table with extra columns from (doc_id, text[, source]) tuples."""

    def build(rows):
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 1, "n", "t", "z", "w") for r in rows]
        return spark.createDataFrame(data, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties."""
    long = " ".join(f"w{i % 7919} v{i}" for i in range(40_000))
    return [
        (1, None), (2, ""), (3, "  \n\t "), (None, "a text whose id is missing but it has words enough"),
        (4, "one"), (5, "one"), (5, "one"), (6, long), (7, long + " tail"), (8, "\n\n\nline\nline\n"), (9, None), (None, None),
        (10, "ends with ▁ and \x00 and \U0001f600"),
    ]
