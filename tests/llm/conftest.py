import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, id string, word string, x int"


@pytest.fixture()
def docs(spark):
    """documents with extra columns of clashing names; None stands for null."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 7, 7, "i", "w", 7) for i, t, lang, src in rows], SCHEMA)

    return make


EDGES = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", None), (4, "same text here again and again", "en", "a"), (5, "same text here again and again", "en", "b"), (None, "no id at all", "fr", "a"), (7, "long word " * 30_000, "de", "a"), (8, "é中文 <|endoftext|> 123!", None, "é")]


@pytest.fixture()
def edges(docs):
    return docs(EDGES)


@pytest.fixture()
def empty(docs):
    return docs([])


@pytest.fixture()
def edge_rows():
    return EDGES
