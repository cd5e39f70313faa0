import pytest
from pyspark.sql import functions as F

EDGE = [
    (0, "a b c d e f g h i", "s1"),
    (1, "a b c d e f g h i", "s1"),
    (2, None, "s1"),
    (3, "", None),
    (4, None, None),
    (5, " \t\n ", "s2"),
    (6, "x " * 9000 + "y", "s2"),
    (7, "é ñ 日本語\nline\nline", "s3"),
    (7, "é ñ 日本語\nline\nline", "s3"),
    (None, "no id here", "s3"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    rows = [(i, t, s, 1, "z", 2.0, b"q", True, 0) for i, t, s in EDGE] + [(9, None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, source string, n int, kept string, size double, digest binary, maybe boolean, did long"
    names = ["_row", "_id", "_host", "_source", "_content", "_words", "_lines", "_text", "_maybe", "_rate", "_copy", "rank", "root", "node", "key", "weight", "left", "part"]
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit(k) for k, c in enumerate(names)})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.filter("false")


def read(spark, name="documents", size="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{size}/{name}.parquet")
