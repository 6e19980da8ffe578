import pytest

SF = "/root/testdata/sf0.001"

WEIRD = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "a"),
    (2, None, "b"),
    (3, "", None),
    (4, "   \t\n ", "d"),
    (5, "single", "e"),
    (6, "one two three four five six seven eight nine ten eleven twelve", "a"),
    (6, "one two three four five six seven eight nine ten eleven twelve", "a"),
    (None, "one two three four five six seven eight nine ten eleven twelve", "n"),
    (7, "wort\u00e4r \u65e5\u672c\u8a9e \U0001f642 z\u00fcrich " * 3, "f"),
    (8, "again and again " * 30_000, "long"),
    (9, "x" * 300_000, "one long word"),
]


@pytest.fixture(scope="session")
def weird(spark):
    """Nulls in every column, empty and very long texts, repeated rows and a repeated id."""
    return spark.createDataFrame(WEIRD, "doc_id long, text string, source string").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
