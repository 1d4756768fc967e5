import pytest

ODD = [None, "", " ", "\n\t ", "a", "Word", "one two three four", "é ß ﬁ ▁ x▁y 😀", "x" * 5000, "same line\nsame line\nother"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, very long and repeated rows, ties, and columns whose names clash with results."""
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    rows = [(i, t, "en", "s", i, 7, "r") for i, t in enumerate(ODD)]
    rows += [(100, long, "en", None, None, 7, None), (100, long, "en", None, None, 7, None), (None, "null id text here now", None, None, 1, 7, "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, row string").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)
