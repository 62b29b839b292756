import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size string, copies string, _row string, score string, _id string, component string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns whose names operators use too."""
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    texts = [
        (1, "the quick brown fox jumps over the lazy dog"), (2, "the quick brown fox jumps over the lazy dog"), (2, "the quick brown fox jumps over the lazy dog"),
        (3, None), (4, ""), (5, " \n\t "), (6, long), (7, long), (None, "orphan text of five words"), (8, "Straße ÉCOLE ciónes 日本語 <|endoftext|> ok"), (9, "one"), (10, "one"),
    ]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None, "own", "own", None, "own", "own", "own") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SHAPE)
