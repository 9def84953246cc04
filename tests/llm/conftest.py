from __future__ import annotations

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, Text string, row int, node string, key int, `group` int"


@pytest.fixture(scope="session")
def table_of(spark):
    """documents, with further columns whose names clash with those of the operators."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "other", 1, "n", 2, 3) for i, t in rows], COLUMNS)

    return make


LONG = " ".join(f"word{i}" for i in range(40_000))
SENTENCE = "One sentence of plain words that says what it says and then it ends as all sentences should do here. "


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (None, SENTENCE * 8),
        (5, SENTENCE * 8),
        (5, SENTENCE * 8),
        (6, "word"),
        (7, LONG),
        (8, LONG),
        (None, None),
        (9, "x" * 300_000),
        (10, "日本語 ひらがな. ퟿ é"),
    ]


@pytest.fixture(scope="session")
def odd(table_of, odd_rows):
    return table_of(odd_rows)


@pytest.fixture(scope="session")
def empty(table_of):
    return table_of([])
