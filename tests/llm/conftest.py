from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, copies, near copies and repeated rows."""
    rng = random.Random(7)
    base, long = sentence(rng, 120), sentence(rng, 30_000)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 2), (3, near, None, "b", 3), (3, near, None, "b", 3),
        (4, None, "en", "a", None), (5, "", "de", None, 0), (None, base, None, None, None), (None, None, None, None, None),
        (6, long, "en", "a", 9), (7, long + " x", "en", "a", 9), (8, "one", "en", "c", 3), (9, "  \t\n ", "en", "c", 5),
        (10, "é ñ 漢字 \U0001f600 ok", "fr", "b", 1), (10, "same id, other text", "fr", "b", 1), (11, "12345 !!!", "en", "a", 1),
        *((100 + k, sentence(rng, rng.randint(1, 60)), rng.choice(["en", "de"]), rng.choice(["a", "b", None]), k) for k in range(60)),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
