"""Small fixtures for the training-data operators."""

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns whose names clash with ours."""
    rows = [
        (1, "the cat sat on the mat and looked at the dog\nshort\n" * 3, 9, "x"),
        (1, "the cat sat on the mat and looked at the dog\nshort\n" * 3, 9, "x"),
        (2, None, None, None),
        (3, "", 0, ""),
        (None, "a row without an id but with words in it", 1, "y"),
        (4, "word " * 30_000, 2, "z"),
        (5, "\x00\x1f ­   日本語 ünï", 3, "z"),
        (6, " \n\t ", 3, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, cid string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
