from __future__ import annotations

import random

import pytest

#: documents, with an extra column whose name an operator may use itself
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item long, key string"
CONTENT = "abcdefghij"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(CONTENT) for _ in range(r.randint(3, 8))) for _ in range(n))


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 7, "k")


@pytest.fixture
def odd(spark):
    """Nulls, empty, blank, repeated, tied and very long texts, and a null id."""
    r = random.Random(1)
    long = words(r, 60_000)
    same = words(r, 40)
    rows = [row(1, None), row(2, ""), row(3, "   \n\n "), row(4, same), row(4, same), row(5, same), row(None, same), row(None, None), row(6, long), row(7, "ß€😀 ▁ x", None, None), row(8, "one")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
