import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
AWKWARD = [
    (1, "The cat sat on the mat. Call +1 (456) 555-2186 or mail Ann.Lee@mail.example.com now.\nA shared line of more than five words here.\n", "a"),
    (2, "", "a"), (3, None, "b"), (4, "x", None), (5, "short one", "b"),
    (6, "A shared line of more than five words here.\nmail ann.lee@mail.example.com from 10.20.30.40", "a"),
    (6, "A shared line of more than five words here.\nmail ann.lee@mail.example.com from 10.20.30.40", "a"),  # a repeated row
    (7, "tie one two three four five six seven", "c"), (8, "tie one two three four five six seven", "c"),
    (None, "a null id with some words in it to count", None), (9, LONG, "c"), (10, "ünïcödé 漢字 😀 \t\r\n mixed space", "a"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls, empty and long texts, ties and repeats, and extra columns whose names the operators use inside."""
    df = spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)
    for c in ("row", "th", "_th", "_new", "_places", "_n", "h", "bucket", "node", "w", "c", "place", "digest", "score", "size", "rank", "kind", "norm", "src", "_k_id", "target"):
        df = df.withColumn(c, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    """(doc_id or -1, text or empty) of every awkward row."""
    return [(-1 if i is None else i, t or "") for i, t, _ in AWKWARD]
