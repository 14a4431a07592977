import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, point long, h long, kind string, n_lines int"


def _row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), 0.5, 1, 2, 3, "k", 9)


ODD = [
    _row(1, "One line\nTwo lines\nThree lines\nFour lines"),
    _row(2, "Zero\nOne line\nTwo lines\nThree lines\nlast of them"),
    _row(2, "Zero\nOne line\nTwo lines\nThree lines\nlast of them"),
    _row(3, None),
    _row(4, ""),
    _row(5, " \n\t \n"),
    _row(None, "a text without an id of its own, long enough to be read"),
    _row(None, None, None, None),
    _row(6, "word " * 30_000, None, "s1"),
    _row(7, "12345 !!! ???", "en", None),
    _row(8, "naïve café über <|endoftext|> done", "fr"),
    _row(2, "another text under a used id"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
