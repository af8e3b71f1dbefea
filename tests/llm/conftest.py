import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs or full rows."""

    def docs(rows):
        full = [(*r, "en", "src0", len(r[1] or ""))[:5] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, DOCS)

    return docs


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, a very long text, repeated rows, ties and an id on two texts."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30000))
    return [
        (None, "a text without an id"), (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, long), (6, long), (7, "same words here again " * 30),
        (7, "same words here again " * 30), (8, "same id other text"), (8, "another text of that id"), (9, "née ñandú 中文 \x00 \x85   end"), (10, "|" * 500), (11, None),
    ]
