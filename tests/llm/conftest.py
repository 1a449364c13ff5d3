import pytest

#: Column names that the operators use inside, to clash with.
EXTRA = ("uid", "h", "k", "part", "size", "key", "target", "text_", "gram", "shard", "hub")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    long = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (2, "", "en", "b", 0),
        (3, None, None, None, None),
        (4, long, "en", "a", len(long)),
        (5, "   \n\t ", "fr", "c", 6),
        (None, "nobody's text under the MIT License here", "en", None, 40),
        (6, "é" * 5000, "fr", "b", 5000),
        (7, "one two three", "en", "é", 13),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in EXTRA:
        df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
