import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, and extra columns whose names operators use themselves."""
    rows = [
        (1, "The first line of a text has words.\nThe second line of it has more words.\n\nA third and last line, of seven words.", "en", "a"),
        (2, "The first line of a text has words.\nThe second line of it has more words.\n\nA third and last line, of seven words.", "en", "a"),
        (3, None, "en", None),
        (4, "", None, "a"),
        (5, "  \n\t ", "en", "b"),
        (6, "One two", "en", "b"),
        (7, "ÀÉ naïve façade 日本語 😀 <|endoftext|> İstanbul ΑΣ\u0301 x\x1cy \u00a0z", "fr", "b"),
        (8, "The second line of it has more words.\nSomething else that only this text says.\nA third and last line, of seven words.", "en", "b"),
        (9, "word " * 30_000 + "end", "en", "c"),
        (6, "One two", "en", "b"),
        (None, "No id here but the first line of a text.", "en", "c"),
    ]
    return spark.createDataFrame([(*r, "p", 1, 2.0, "h") for r in rows], "doc_id long, text string, lang string, source string, id string, n int, p double, h string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]
