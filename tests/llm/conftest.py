import pytest

#: Texts with the odd cases: null, empty, blank, no letters, very long, repeated rows, ties.
TEXTS = [
    (1, "the cat sat on the mat and the cat sat on the mat again today"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "12345 !!! ###"),
    (6, "word " * 30_000),
    (1, "the cat sat on the mat and the cat sat on the mat again today"),
    (7, "The Cat sat on the mat and the cat sat on the mat again today"),
    (8, "a\nb\na\n\n\nb c $%&| <x>"),
    (None, "no id here but text"),
    (9, "ÄÖÜ straße ñandú été naïve İstanbul 你好 世界"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The odd cases, with extra columns whose names clash with those that operators make."""
    rows = [(i, t, "x", 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, n_words int")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
