import pytest

#: Texts that every operator must survive: null, empty, blank, very long, repeated rows, ties, accents.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, " \t\n "), (5, "The quick brown fox jumps over the lazy dog."), (5, "The quick brown fox jumps over the lazy dog."),
    (None, "an orphan row without an id"), (6, "x" * 50_000), (7, "été à la plage ÉTÉ ß straße"), (8, "one"), (9, "word " * 20_000), (10, "12345 !!! ??? \U0001f600"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The texts with extra columns whose names clash with those the operators make."""
    rows = [(i, t, "en" if k % 2 else None, "src0" if k % 3 else None, k, "c", k, "k") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, score int, key string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
