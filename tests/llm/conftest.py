import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, v string, u int, fp string, score double, n_words int, n int, __note string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog and runs away from here", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from here", "en", "b"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from here", "en", "b"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "  \t\n ", "de", "c"),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund und läuft dann weg", "de", "a"),
    (6, "ÄÖÜ ß 漢字 \U0001f600 mixed Text", None, "c"),
    (7, LONG * 800, "en", "a"),
    (8, "one\ntwo words\n\nPage 3 of 10 in this report\nfour tokens are here", "en", None),
    (9, "other\nPage 4 of 12 in this report\nfour tokens are here\nand a line of its own that stays", "en", "b"),
    (None, "no id at all but words enough to be a text", "en", "b"),
    (10, "x", "en", "a"),
]


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, blanks, a long text, repeated rows, and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "v", 1, "f", 0.5, 7, 3, "x") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
