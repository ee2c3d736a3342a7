import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) pairs; extra columns bear the names operators use inside."""

    def build(rows):
        full = [(d, t, "en", f"src{(d or 0) % 3}", None if t is None else len(t), 7, "x", 1.0) for d, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, bucket long, key string, "
                  "weight double")

    return build


ODD_ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two three four five six"),
    (6, "one two three four five six"), (None, "a text without an id, of more than five words"),
    (7, "long " * 30_000), (8, "ünï çødé 漢字 テスト words of many kinds here"), (8, "a repeated id with another text in it"),
    (9, "same row twice for a test of repeated rows"), (9, "same row twice for a test of repeated rows"),
]


@pytest.fixture
def odd(documents):
    return documents(ODD_ROWS)


@pytest.fixture
def empty(documents):
    return documents([(1, "x")]).limit(0)
