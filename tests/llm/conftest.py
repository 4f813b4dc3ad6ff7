import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, and columns with clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again until it is dark outside", "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog again and again until it is dark outside", "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog again and again until it is dark outside", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n ", None, "b", 4),
        (6, "one two", "de", None, 7),
        (7, long, "fr", "c", len(long)),
        (8, "Ünïcode äöü 漢字 words", "de", "c", 5),
        (None, "a row without an id but with some words in it", "en", "c", 5),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, schema)
    for name in ("key", "rest", "bucket", "fp", "node", "slot", "size", "home", "block", "shard", "__s", "grade", "u", "v", "nth", "one"):
        frame = frame.selectExpr("*", f"'{name}' AS `{name}`")
    return frame


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
