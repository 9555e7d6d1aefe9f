import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and white texts, a long text, repeated rows, a doc_id with two texts, clashing names."""
    line = "All rights reserved by the owner."
    texts = [
        (1, f"{line}\nfirst words of this text"), (2, f"  {line.upper()}  \nother words"), (2, f"{line}\nsecond text of this id"), (None, f"{line}\nno id"),
        (3, None), (4, ""), (5, " \t\n "), (6, "x " * 40_000), (7, "same row " * 60), (7, "same row " * 60), (8, "é" * 300 + "\n" + "é" * 300), (9, "short"),
    ]
    rows = [(i, t, None if i == 3 else "en", "s", len(t or ""), "w", 1) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, row bigint")
