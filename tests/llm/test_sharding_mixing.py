from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

from priorline.llm import mixing, sharding


def test_shards_are_gapless_and_growth_moves_rows_into_the_new_shard_only(spark, frame, words):
    rows = [(i, " ".join(words(i % 9, i))) for i in range(3000)]
    got = sharding.shard_rows(frame(rows), 24).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert 0 < sum(r.grown_shard == 24 for r in got) < 300
    text = dict(rows)
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and int(r.size) == len(text[r.doc_id].encode()) + 8 for r in got)


def test_weights_and_awkward_rows(spark, frame, awkward):
    got = sharding.shard_rows(frame(awkward), 4, [1, 1, 1, 9]).collect()
    assert len(got) == len(awkward)
    assert len({r.shard for r in got if r.doc_id == 8}) == 1
    assert "fp" in got[0].asDict() and got[0].law == "key"
    many = sharding.shard_rows(frame([(i, "") for i in range(2000)]), 4, [1, 1, 1, 9]).groupBy("shard").count().collect()
    assert {r.shard: r["count"] for r in many}[3] > 1300
    assert sharding.shard_rows(frame([])).count() == 0


def test_shards_against_plain_rendezvous(spark, frame, words, awkward):
    def best(key: str, shards: int) -> int:
        def score(s: int) -> float:
            u = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u)

        return min(range(shards), key=score)

    rows = [(i, " ".join(words(i % 9, i))) for i in range(700)] + [(None if d is None else 10_000 + d, t) for d, t, *_ in awkward]
    got = sharding.shard_rows(frame(rows), 24).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "\0" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (best(key, 24), best(key, 25))


def test_names_that_clash_in_any_case(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5, 6)], "doc_id long, text string, source string, Size long, TAKEN long")
    assert mixing.mix(docs).select("size", "taken").collect() == [(2, 2 * mixing.mix(docs).first()["copies"])]
    assert sharding.shard_rows(docs).select("size").first()[0] == 11


def test_mixing_of_ties_does_not_depend_on_the_order_of_rows(spark, frame):
    rows = [(i % 3, f"{'x' * (i // 3 + 1)} tie", "en", "ab"[i % 5 == 0]) for i in range(90)] + [(None, "no key", "en", "a"), (None, "key no", "en", "a")]
    copies = [Counter((r.doc_id, r.text, r.copies) for r in mixing.mix(frame(x)).collect()) for x in (rows, rows[::-1])]
    assert copies[0] == copies[1]


def brute_targets(sizes: dict, weights=(1, 2, 3)) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        rest = total - sum(target.values())
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if 3 * sizes[s] <= level * w[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
        open_ -= over
    return target


def test_mixing_meets_targets(spark, frame, words):
    rows = [(i, " ".join(words(5 + i % 40, i)), "en", ["big", "mid", "tiny", None][0 if i % 10 < 6 else 1 if i % 10 < 9 else 2 if i % 20 == 9 else 3]) for i in range(4000)]
    got = mixing.mix(frame(rows)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(dict(sizes))
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert abs(own[0].target - want[s]) < 1e-6 * want[s] and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= max(0.01 * want[s], 100)
    assert all(r.copies <= 3 and r.taken == r.copies * r["size"] for r in got)
    again = mixing.mix(frame(list(reversed(rows)))).select("doc_id", "copies").collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in got}


def test_mixing_awkward(spark, frame, awkward):
    mixed = mixing.mix(frame(awkward))
    assert mixed.count() == len(awkward)
    assert mixing.take(mixed, ["doc_id", "text"]).count() == mixed.agg({"copies": "sum"}).first()[0]
    assert mixing.mix(frame([])).count() == 0
    assert [r.taken for r in mixing.mix(frame([(1, None), (2, "")])).collect()] == [0, 0]
