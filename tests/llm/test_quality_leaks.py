from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorline.llm import common, leaks, quality


def brute_repeated(words: list[str]) -> int:
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if runs[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return len(covered)


def test_base_metrics():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(["a ", "b ", "é ", "#x ", "\n", "a b\n", "\x0b", "%"], k=rng.randint(0, 80)))
        words = text.replace("\x0b", " ").split()
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), brute_repeated(words))
        assert quality.base_metrics(text.encode()) == want


def brute_model(texts: list[str]):
    """Modified Kneser-Ney over byte n-grams with counts less one: a function from an n-gram to its probability."""
    counts = Counter()
    for t in texts:
        b = "".join(c.lower() if c.isascii() else c for c in t).encode()
        counts.update(b[i : i + quality.ORDER] for i in range(len(b) - quality.ORDER + 1))
    tables = {quality.ORDER: {g: n - 1 for g, n in counts.items()}}
    for order in range(quality.ORDER - 1, 0, -1):
        found = Counter()
        for g, n in tables[order + 1].items():
            found[g[1:]] += n > 0
        tables[order] = found
    stats = {}
    for order, table in tables.items():
        n = [sum(c == k for c in table.values()) for k in (1, 2, 3, 4)]
        y = n[0] / max(n[0] + 2 * n[1], 1)
        cut = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) if min(n) > 0 else 0.5 for k in (1, 2, 3)]
        held: dict = {}
        for g, c in table.items():
            if c:
                held.setdefault(g[:-1], []).append(c)
        stats[order] = (cut, {x: (sum(cs), sum(cut[min(c, 3) - 1] for c in cs)) for x, cs in held.items()})

    def p(g: bytes) -> float:
        if not g:
            return 1 / 256
        cut, held = stats[len(g)]
        lower = p(g[1:])
        if g[:-1] not in held:
            return lower
        total, left = held[g[:-1]]
        c = tables[len(g)].get(g, 0)
        return (max(c - (cut[min(c, 3) - 1] if c else 0), 0) + left * lower) / total

    return p


def brute_nats(text: str, *models) -> list[float]:
    b = "".join(c.lower() if c.isascii() else c for c in text).encode()
    return [[-np.log(m(b[i : i + quality.ORDER])) for i in range(len(b) - quality.ORDER + 1)] for m in models]


def test_verdicts_against_a_plain_model(spark, frame, words):
    """Perplexities of the exchange are those of a model held whole, and so are the verdicts by both ends of the band."""
    rng, rows = random.Random(6), []
    for i in range(260):
        lang = ("en", "de", None)[i % 3]
        body = words(rng.randint(25, 60), i)
        if i % 20 == 0:
            body = ["".join(rng.choices("qxzwjkv", k=7)) for _ in body]
        if i % 20 == 1:
            body = words(9, 5) + body[:9] + words(9, 5)
        rows.append((i, " ".join(body) + (" \u00e9\u00fc" if i % 7 == 0 else ""), lang))
    rows += [(900, "abc", "en"), (901, None, "en"), (902, "Word " * 30, "zz")]
    got = {r.doc_id: r for r in quality.judge(frame(rows)).collect()}
    pooled = brute_model([t or "" for _, t, _ in rows])
    for lang in ("en", "de", None, "zz"):
        own = [(d, t or "") for d, t, x in rows if x == lang]
        model, measured = brute_model([t for _, t in own]), {}
        for d, t in own:
            mine, every = brute_nats(t, model, pooled)
            if mine:
                runs = range(0, len(mine), quality.SEGMENT)
                measured[d] = (np.mean(mine), sum(min(sum(mine[i : i + quality.SEGMENT]), sum(every[i : i + quality.SEGMENT])) for i in runs) / len(mine), len(mine))
            assert (got[d].nats is None) == (not mine)
        ends = []
        for k in (0, 1):
            bins = np.array([np.floor(v[k] * quality.BINS + 0.5) for v in measured.values()])
            centre = np.median(bins)
            ends.append((centre / quality.BINS, max(np.median(np.abs(bins - centre)) * 1.4826, 5.0) / quality.BINS))
        for d, (nats, eased, n) in measured.items():
            assert got[d].nats == pytest.approx(nats, abs=1e-5)
            unit = np.sqrt(1 + quality.NOISE_BYTES / n)
            low, high = (nats - ends[0][0]) / ends[0][1] / unit, (eased - ends[1][0]) / ends[1][1] / unit
            if min(abs(low + quality.BAND_BELOW), abs(high - quality.BAND_ABOVE)) > 0.01:
                assert got[d].kept == (not got[d].base_failed and low >= -quality.BAND_BELOW and high <= quality.BAND_ABOVE)


@pytest.fixture(scope="module")
def corpus(words):
    return [(i, " ".join(words(80, i)), "en" if i % 2 else "de") for i in range(200)]


def test_quality_keeps_clean_and_the_band_rejects(spark, frame, corpus, awkward, monkeypatch):
    got = {r.doc_id: r for r in quality.judge(frame([*corpus, (501, "go on " * 200, "en")])).collect()}
    assert all(got[d].kept and not got[d].base_failed for d, *_ in corpus)
    assert got[501].base_failed and not got[501].kept
    monkeypatch.setattr(quality, "BAND_ABOVE", 0.0)
    narrow = quality.judge(frame(corpus)).collect()
    monkeypatch.undo()
    assert 0 < sum(r.kept for r in narrow) < len(narrow)
    rows = quality.judge(frame(awkward)).collect()
    assert len(rows) == len(awkward) and {r.doc_id: r.base_failed for r in rows}[1]
    assert quality.judge(frame([])).count() == 0


def test_blocks_and_buckets_change_nothing(spark, frame, corpus, monkeypatch):
    want = {r.doc_id: r.perplexity for r in quality.judge(frame(corpus)).collect()}
    monkeypatch.setattr(quality, "MOST_SENT_GRAMS", 0)
    monkeypatch.setattr(quality, "MOST_HELD_GRAMS", 100)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(quality, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(quality, "MOST_SENT_BANDS", 0)
    got = {r.doc_id: r.perplexity for r in quality.judge(frame(corpus)).collect()}
    assert got == pytest.approx(want)



def brute_leaks(rows, items) -> set:
    found = set()
    for item, text in items:
        q, a = leaks.question_and_answer(text or "")
        runs = leaks.shingles(q + a)
        for d, t in rows:
            have = leaks.shingles(leaks.words_of((t or "").lower().encode()))
            if runs and len(runs & have) >= 0.8 * len(runs):
                found.add((d, item))
    return found


def test_leaks_against_all_pairs(spark, frame, words, awkward):
    items = [(k, ". ".join([" ".join(words(18, 50 + k)), " ".join(words(6, 70 + k))]) + ".") for k in range(20)] + [(30, None), (31, "")]
    rows = []
    for i in range(120):
        body = words(150, 1000 + i)
        if i % 4 == 0:
            at = random.Random(i).randint(0, 150)
            copy = items[i // 4 % 20][1].upper().split()
            if i % 8 == 0:
                copy[1] = "changed"
            body = body[:at] + copy + body[at:]
        if i % 7 == 0:
            body = body + items[i % 20][1].split()[:12]
        rows.append((i, " ".join(body)))
    # Awkward rows are numbered apart from the others, which are told apart by doc_id below.
    rows += [(None if r[0] is None else 1000 + r[0], r[1]) for r in awkward]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.find_leaks(frame(rows), benchmark).collect()
    want = brute_leaks(rows, items)
    assert len(want) > 20 and {(r.doc_id, r.item_id) for r in got} == want
    left = leaks.without_leaks(frame(rows), benchmark)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert leaks.find_leaks(frame([]), benchmark).count() == 0
    assert leaks.find_leaks(frame(rows), benchmark.limit(0)).count() == 0


def test_items_in_blocks_give_the_same(spark, frame, words, monkeypatch):
    items = [(k, " ".join(words(25, 50 + k))) for k in range(12)]
    rows = [(i, " ".join(words(40, 900 + i)) + " " + items[i % 12][1]) for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leaks, "ITEMS_AT_ONCE", 4)
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(frame(rows), benchmark).collect()} == {(i, i) for i in range(12)}


def test_each_order_is_counted_once(spark, monkeypatch):
    stored, durable = [], quality.durable
    monkeypatch.setattr(quality, "durable", lambda df: stored.append(df) or durable(df))
    counts = spark.createDataFrame([("en", int.from_bytes(g.encode(), "big"), n) for g, n in (("abcde", 3), ("bcdea", 2), ("cdeab", 1))], "lang string, code long, n long")
    assert quality.kneser_ney(counts).count() == 3
    counted = [df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") for df in stored]
    assert counted == [0] + [1] * (quality.ORDER - 1)


def test_what_is_stored_leaves_no_shuffle(spark):
    blocks = spark._jsc.sc().env().blockManager().diskBlockManager()
    left = lambda: sum(".data" in str(blocks.getAllFiles().apply(i)) for i in range(blocks.getAllFiles().size()))
    spark._jvm.System.gc()
    time.sleep(3)
    before = left()
    rows = [common.settled(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))) for _ in range(4)]
    until = time.time() + 20
    while left() > before and time.time() < until:
        time.sleep(0.5)
    assert left() <= before and [r.agg(F.sum("s")).first()[0] for r in rows] == [499500] * 4


def test_an_order_meets_its_contexts_in_one_move(spark, monkeypatch):
    counts = spark.createDataFrame([("en", int.from_bytes(g.encode(), "big"), n) for g, n in (("abcde", 3), ("bcdea", 2), ("cdeab", 1))], "lang string, code long, n long")
    plan = quality.kneser_ney(counts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == quality.ORDER
