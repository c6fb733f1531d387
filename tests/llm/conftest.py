import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"

EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t \n"),
    (4, "one"),
    (5, "one two three four"),
    (6, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"),
    (7, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"),
    (8, "x" * 40000),
    (9, "word " * 20000),
    (10, "word " * 20000),
    (11, "a b a b a b a b a b a b a b a b a b a b a b a b a b\n\na b a b a b a b a b a b a b"),
    (12, "café naïve \U0001f600 x y z\nLine two has several words in it\nLine two has several words in it"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empties, repeats, long texts and columns whose names clash with the operators' own."""
    rows = [(i, t, None if i % 2 else "en", 1, 2, "c", 0.5, "k") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, id int, label string, score double, word string")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def words(t):
    return WORD.findall(t or "")
