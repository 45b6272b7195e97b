from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _hash string, fp string"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text[, lang, source]) as documents with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 7))) for _ in range(3000)]

    def take(n: int, seed: int) -> list[str]:
        return random.Random(seed).choices(vocabulary, k=n)

    return take


@pytest.fixture(scope="session")
def awkward(words):
    """Nulls, empty, blank, one-word, very long and repeated texts, equal rows and null keys."""
    long = " ".join(words(30_000, 1))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, long), (6, long + " end"), (7, "same text here"), (8, "same text here"), (8, "same text here"),
        (None, "same text here"), (9, "é ü " * 40, None, None), (10, "\n".join(["one line of several words"] * 5), "de", None), (11, "😀 emoji 😀", "xx", "b"),
    ]
