from __future__ import annotations

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size long, _key long, predicted int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, blanks, repeats, a very long text, and extra columns that clash with the operators' own."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, "a b c d e f", "s1"), (2, None, "s1"), (3, "", None), (4, " \t\n ", "s2"), (5, long, "s2"), (None, "a b c d e f", "s1"),
        (None, None, None), (6, "A  b\nC d e f", "s1"), (6, "A  b\nC d e f", "s1"), (7, "é ü 日本 🙂 x", ""), (8, "x" * 50_000, "s2")
    ]
    return spark.createDataFrame([(i, t, None, s, None, 0.5, 9, 9, 9, 9) for i, t, s in rows], SHAPE)


FAR = 2**53 + 1


@pytest.fixture(scope="session")
def far_ids(spark):
    """An id that a double cannot hold, in one batch with a null one."""
    return spark.createDataFrame(
        [(FAR, "a b c d e f g"), (None, "a b c d e f g"), (-FAR, "other words than these")], "doc_id long, text string"
    ).coalesce(1)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("doc_id < 0")
