from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from priorline.llm import quality


@pytest.fixture(scope="module")
def corpus(words):
    return [(i, " ".join(words(80, i)), "en" if i % 2 else "de") for i in range(3000)]


def test_noise_is_rejected_and_a_quoted_language_is_not(spark, frame, corpus):
    """The corpus is large enough that its models don't learn the noise."""
    rng = random.Random(4)
    other = ["".join(rng.choices("qvwxyzkj", k=rng.randint(2, 7))) for _ in range(300)]
    foreign = [(10_000 + i, " ".join(random.Random(i).choices(other, k=80)), "fr") for i in range(1500)]
    quoting = (20_000, corpus[1][1] + " " + foreign[0][1] + " " + corpus[3][1], "en")
    noise = "".join(random.Random(9).choices([chr(c) for c in range(33, 126)] + [" "] * 9, k=3000))
    hexes = " ".join("".join(rng.choices("0123456789abcdef", k=8)) for _ in range(100))
    letters = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(100))
    judged = quality.judge(frame([*corpus, *foreign, quoting, (500_000, noise, "en"), (500_001, letters, "de"), (500_002, hexes, "en")]))
    got = {r.doc_id: r.kept for r in judged.collect()}
    assert {d for d, kept in got.items() if not kept} == {500_000, 500_001, 500_002}
    assert judged.filter(F.col("doc_id") >= 500_000).filter("base_failed").count() == 0
