import pytest

LONG = "lorem ipsum dolor " * 20_000
#: NULLs in any column, empty and blank texts, a very long text and word, ties, repeated rows and ids.
ROWS = [
    (1, "", "en", "a"),
    (2, None, "en", "a"),
    (None, "the words of a row without an id", None, None),
    (None, None, None, None),
    (3, LONG, "en", "b"),
    (4, "x" * 30_000, "en", "b"),
    (5, "one two three four five", "en", "b"),
    (5, "one two three four five", "en", "b"),
    (6, "one two three four five", "fr", "b"),
    (6, "another text under the same id", "fr", None),
    (7, " \n\t ", "de", "c"),
    (8, "!!! ???", "de", "c"),
    (9, "é ß 漢字 🎉 mail a.b@example.com", "es", "c"),
    (10, "short", "es", "c"),
    (11, "two words", None, "c"),
]
COLUMNS = "doc_id long, text string, lang string, source string"
#: Extra columns with the names that operators use inside.
EXTRA = ["token", "row", "size", "key", "group", "position", "shard", "fingerprint", "ids", "n", "keep", "rule", "_at", "_key", "language", "entities", "first", "mark1", "home"]


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, COLUMNS)
    return df.select(*[F.lit(i).alias(c) for i, c in enumerate(EXTRA)], "*").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
