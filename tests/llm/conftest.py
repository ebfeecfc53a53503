from __future__ import annotations

import pytest

LONG = "long words stand here again and again. " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (None, "no number here but words enough to be counted as a text", "s"), (1, None, None), (1, None, None), (2, "", "s"), (3, " \n\t ", "s"), (4, "a b c", None), (5, "A  B\nc", "s"),
        (6, LONG, "s"), (7, LONG, "t"), (7, LONG, "t"), (8, LONG + " ", "t"), (9, "é中 😀 \x00 ▁x", "s"), (10, "one line\none line\n", "s"), (None, None, None),
    ]
    data = [(i, t, s, 1, 2, "x", 3, 4.0) for i, t, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, row int, fp int, hash string, __row int, score double").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 1), (None, 1, 1), (6, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
