import pytest

SF001 = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, fp long, fingerprint string, chunk long, key long, score double, unit int, word string, n long, size int, piece_ids string, component_id long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and long texts, repeated rows and ids, columns that clash with those inside."""
    long = " ".join(f"word{i % 700} thing{i % 311}" for i in range(30_000))
    texts = [
        (1, "Some plain words that make a line of text\nand another line that is not repeated"),
        (2, "Some plain words that make a line of text\nand a third line of its own here"),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (6, long),
        (7, long + " end"),
        (8, "12 34 56 !!"),
        (8, "12 34 56 !!"),
        (9, "Some plain words that make a line of text"),
        (9, "another text of the same document number nine"),
        (None, "Some plain words that make a line of text"),
        (None, None),
        (10, "ÉÀ ▁ 漢字 \U00010348 \x00 ends"),
        (11, "one"),
    ]
    rows = [(i, t, None if k % 3 else "en", k, "x", k, k, 0.5, k, "w", 1, 2, "p", 5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
