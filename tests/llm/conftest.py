import pytest

LONG = "Eine lange Zeile mit Worten, die immer weiter geht und niemals endet. " * 30_000
ROWS = [
    (1, "The first text is here.\nIt has two lines.", "en", 1), (1, "The first text is here.\nIt has two lines.", "en", 1), (2, None, None, None), (3, "", "en", 0), (4, " \t\n\x0b ", "de", 0),
    (5, LONG, "de", 1), (6, "😀 ünïcode ﬁ\x00 '' \\ \"", "fr", None), (None, "no id", "en", 1), (7, "***", None, 0), (8, "a", "en", 1), (9, "The first text is here.\nIt has two lines.", "en", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, very long and repeated rows, under clashing extra columns."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, quality int")
    for c in ("row", "lines", "lost", "fp", "key", "h", "bucket", "n", "rest", "kept", "root", "good", "score", "clean", "part", "html_", "words"):
        df = df.withColumn(c, df.doc_id)
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
