import pytest


@pytest.fixture(scope="session")
def llm_rows(spark):
    """Awkward documents: nulls, empty, ties, repeats, long, clashing extra columns."""
    rows = [
        (1, "one two three", "en", "a", 13),
        (2, "one two three", "en", "a", 13),
        (2, "one two three", "en", "a", 13),
        (None, "one two three", None, None, None),
        (3, None, "en", None, None),
        (4, "", None, "b", 0),
        (5, " \t\n\r\x0b\x0c ", "fr", "b", 7),
        (6, "x" * 400_000 + " tail", "de", "a", 400_005),
        (7, "Ünï códe here and there " * 40, "en", "c", 100),
        (7, "another text under the same id", "en", "c", 30),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
