from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from priorline.llm import passages
from test_near_duplicates import classes

P, S = passages.PASSAGE, passages.LEAST_SHARED


def near(a: list[str], b: list[str]) -> bool:
    """Whether some windows of fifty words share 0.8 of their five-word runs, tried for every pair of windows."""

    def windows(words):
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        return [Counter(runs[i : i + P]) for i in range(len(runs) - P + 1)]

    theirs = windows(b)
    return any((x & y).total() >= S for x in windows(a) for y in theirs)


def near_in_two_blocks(a: list[str], b: list[str]) -> bool:
    """The module's definition, for texts whose five-word runs repeat within a passage: every common run with every other behind it."""
    one, two = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (a, b))
    if min(len(one), len(two)) < P:
        return False
    n, m = len(one), len(two)
    run = np.zeros((n + 60, m + 60), int)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            run[i, j] = run[i + 1, j + 1] + 1 if one[i] == two[j] else 0
    i, j = np.nonzero(run)
    x = run[i, j]
    if (x >= S).any():
        return True
    gaps = range(passages.SPARE + 1)
    return any((x + run[np.minimum(i + x + g, n), np.minimum(j + x + h, m)] >= S).any() for g in gaps for h in gaps)


def edited(passage: list[str], rng: random.Random) -> list[str]:
    out = list(passage)
    for _ in range(rng.randint(0, 3)):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if rng.random() < 0.6:
            at = rng.choice([0, 1, 2, len(out) - 1, len(out) - 2])
        if kind == 0:
            out[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, f"more{rng.randrange(10**6)}")
    return out


def got_classes(spark, frame, rows, **sizes):
    return {r.doc_id: (r.class_id, r.n_others) for r in passages.passage_classes(frame(rows), **sizes).collect()}


@pytest.mark.parametrize("hot", [256, 0])
def test_against_all_windows(spark, frame, words, hot):
    """Passages of 40 to 60 words with edits near and beyond the limit; classes are those of all pairs of windows."""
    rng, texts = random.Random(8), []
    for k in range(150):
        passage = words(40 + (k % 10) * 2, 1000 + k % 10)
        texts.append(words(rng.randint(0, 12), 2000 + k) + edited(passage, rng) + words(rng.randint(0, 12), 3000 + k))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near(texts[i], texts[j])]
    want = classes(pairs, range(len(texts)))
    count = Counter(want.values())
    assert 5 < len(set(want.values())) < 140
    got = got_classes(spark, frame, [(i, " ".join(t)) for i, t in enumerate(texts)], hot_blocks=hot, block_bytes=8000)
    assert got == {i: (want[i], count[want[i]] - 1) for i in want}


def test_no_near_copy_is_lost_wherever_its_word_changed(spark, frame, words):
    """Pairs of documents with a passage of 50 words, one of them changed, dropped or doubled; other words around it."""
    rows, want = [], {}
    for word in range(passages.WORDS):
        for k in range(6):
            seed = 10_000 + 100 * word + 10 * k
            passage = words(passages.WORDS + (k % 3 > 0), seed)
            changed = [*passage[:word], *([["changed"], [], [passage[word], "more"]][k % 3]), *passage[word + 1 :]]
            first = 2 * (6 * word + k)
            rows += [(first, " ".join(words(60, seed + 1) + passage + words(60, seed + 2))), (first + 1, " ".join(words(60, seed + 3) + changed + words(60, seed + 4)))]
            want |= {first: (first, 1), first + 1: (first, 1)}
    assert got_classes(spark, frame, rows) == want


@pytest.mark.parametrize("size", [2, 12, 13, 40, 300])
def test_groups_of_any_size_are_whole(spark, frame, words, size):
    """Near copies in one group, each with an own word in each stretch of 51: the near passages of all pairs are found."""
    base, rows = words(204, 77), []
    for k in range(size):
        own = [f"own{k}x{i}" if i % 51 == 25 + k % 2 else w for i, w in enumerate(base)]
        rows.append((k, " ".join(words(20, 9000 + k) + own + words(20, 99_000 + k))))
    few = min(size, 13)
    split = [r[1].split() for r in rows[:few]]
    pairs = [(i, j) for i in range(few) for j in range(i) if near(split[i], split[j])]
    want = classes(pairs, range(few))
    got = got_classes(spark, frame, rows)
    assert {i: got[i][0] for i in range(few)} == want
    assert set(want.values()) == {0} and set(got.values()) == {(0, size - 1)}


def test_a_common_line_joins_nothing(spark, frame, words):
    """A line of forty words in every document is no passage, and two near passages beside it are found."""
    line = words(40, 5)
    rows = [(k, " ".join(words(30, 100 + k) + line + words(30, 5000 + k))) for k in range(200)]
    extra = words(9, 6)
    rows += [(300, " ".join(words(30, 7) + line + ["this"] + extra + words(30, 8))), (301, " ".join(words(30, 9) + line + ["that"] + extra + words(30, 10)))]
    got = got_classes(spark, frame, rows)
    assert got == {k: (k, 0) for k in range(200)} | {300: (300, 1), 301: (300, 1)}


def test_texts_of_few_words(spark, frame):
    """Texts that say a few words over and over: equal passages link."""
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["x", "y"], k=200))) for k in range(60)] + [(100 + k, "x " * (50 + k)) for k in range(5)] + [(200, "y x " * 40), (201, "x y " * 90)]
    got = got_classes(spark, frame, rows)
    assert {got[100 + k][0] for k in range(5)} == {100} and got[200] == got[201]


def test_words_over_and_over(spark, frame, words):
    """Stretches of one word with other words around and between them, equal and near ones, against all pairs of windows."""
    rng, texts = random.Random(4), []
    for k in range(120):
        text = words(rng.choice([0, 8, 14]), rng.randrange(6))
        for _ in range(rng.randint(1, 3)):
            text += [rng.choice(["la", "so"])] * rng.choice([3, 26, 30, 31, 44, 60]) + words(rng.choice([6, 15]), 50 + rng.randrange(5))
        texts.append(text)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near_in_two_blocks(texts[i], texts[j])]
    want = classes(pairs, range(len(texts)))
    got = got_classes(spark, frame, [(i, " ".join(t)) for i, t in enumerate(texts)])
    assert {i: c for i, (c, _) in got.items()} == want and 3 < len(set(want.values()))


def test_awkward_rows(spark, frame, awkward):
    got = passages.passage_classes(frame(awkward)).collect()
    assert len(got) == len(awkward)
    assert {(r.doc_id, r.class_id) for r in got} >= {(5, 5), (6, 5), (1, 1), (None, None)}
    assert passages.passage_classes(frame([])).count() == 0


def test_parts_join_in_bulk():
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, 500, 300), rng.integers(0, 500, 300)
    parts = passages.Parts(np.arange(500))
    parts.join(one, two)
    want = classes(zip(one.tolist(), two.tolist(), strict=True), range(500))
    assert parts.label.tolist() == [want[i] for i in range(500)]
