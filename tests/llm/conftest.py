import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and blank texts, repeated rows, ties, a clashing extra column, one long text."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (4, " \n \n"), (5, "a b c d e"), (None, "a b c d e"), (None, None), (6, long), (7, "é Ünïcode 日本 🙂 <|endoftext|> x"), (8, "a" * 5000)]
    return spark.createDataFrame([(i, t, "en", "s", 0, "mine") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_tokens string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
