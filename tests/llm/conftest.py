import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, class_id string, words string"
A = "the quick brown fox jumps over the lazy dog and runs far away from here today"
B = "der schnelle braune fuchs springt über den faulen hund und läuft heute weit weg von hier"


def row(doc_id, text, lang="en", n_chars=None):
    return doc_id, text, lang, "s", n_chars, "x", "y", "z"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names clash with results."""
    long = " ".join(f"word{i % 977} other{i}" for i in range(30_000))
    rows = [row(1, A), row(2, A), row(2, A), row(3, None), row(4, ""), row(5, " \n\n"), row(6, "!!! ... 123"), row(7, B, "de"),
            row(8, long), row(None, A), row(None, None, None), row(9, B, None), row(10, "one"), row(11, f"{A}\n{B}\n{A}")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
