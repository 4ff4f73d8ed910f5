import pytest

LONG = "word " * 30_000


def documents(spark, rows):
    """rows: (doc_id, text); further columns include names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id int, score double")


#: Nulls, empty and very long texts, ties and repeated rows, odd characters.
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "a b c d e"), (5, "a b c d e"), (6, "a b c d e"), (None, "a b c d e"), (7, "日本語 テキスト\n\nx"), (8, "A b́ <|endoftext|> it's ▁ \x00 \x1c 1/2 é"), (None, None), (9, "x" * 50_000)]


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def sample(spark):
    """Whole texts of the smallest table, as rows (doc_id, text)."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]
