from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from priorline.llm import components, lines, passages, simhash, substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_fingerprint(text: str) -> int:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    counts = [0] * 64
    for run in runs:
        h = xxhash.xxh64_intdigest(run.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(runs))


def classes(pairs, nodes) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_against_all_pairs(spark, frame, words, awkward):
    rows = [(i, " ".join(words(60, i % 70) + words(i % 3, i))) for i in range(100, 400)]
    rows += [r[:2] for r in awkward if r[0] not in (None, 8)] + [(8, "same text here")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(rows)).collect()}
    prints = {d: brute_fingerprint(t or "") for d, t in rows}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = classes(pairs, ids)
    assert got == {d: (f"{prints[d]:016x}", root[d]) for d in ids}
    assert simhash.near_duplicates(frame([])).count() == 0
    assert simhash.near_duplicates(frame(awkward)).count() == len(awkward)


def test_ring_keys_meet_for_all_close_pairs():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    keys_a, keys_b = simhash.ring_keys(a), simhash.ring_keys(b)
    start = (keys_a >> np.uint64(30)).astype(np.int64)
    met = (keys_a == keys_b) & simhash.linked(np.repeat(a[:, None], keys_a.shape[1], 1), np.repeat(b[:, None], keys_a.shape[1], 1), start)
    assert met.any(axis=1).all()


def test_a_large_group_is_connected_without_all_pairs():
    base = np.uint64(0x123456789ABCDEF0)
    fps = np.unique(np.array([base ^ np.uint64((1 << i) | (1 << j)) for i in range(30, 64) for j in range(i, 64)], np.uint64))
    a, b = simhash.group_links(np.zeros(len(fps), np.uint64), fps)
    assert len(a) < len(fps)
    assert len(set(classes(zip(a.tolist(), b.tolist(), strict=True), fps.tolist()).values())) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 101), (7, 3), (200, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows) -> dict:
    first: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\x01" * 50
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_substrings_against_all_windows(spark, frame):
    rng = random.Random(1)
    base, rows = "".join(rng.choices("abcd é", k=400)), []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, 380)
            piece = list(base[a : a + rng.randint(20, 200)])
            if piece and rng.random() < 0.5:
                piece[rng.randrange(len(piece))] = "X"
            parts.append("".join(piece) if rng.random() < 0.6 else "".join(rng.choices("ab", k=rng.randint(1, 90))))
        rows.append((i * 3, "".join(parts) or None))
    rows += [(1000, "ab" * 500), (1001, "ab" * 300 + "c" + "ab" * 300)]
    want = brute_repeats(rows)
    for sizes in ({"block_bytes": 3000}, {"block_bytes": 1500, "hot_blocks": 0}):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(frame(rows), **sizes).collect()}
        assert got == want


def test_hot_anchors_send_each_string_once(spark, frame):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abcdef", k=150)) + "the passage that all of these documents have in common, word by word" + "".join(rng.choices("abcdef", k=150))) for i in range(60)]
    want = brute_repeats(rows)
    for limits in ({"hot_blocks": 0}, {"most_around": 0}, {"most_around": 5}):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(frame(rows), block_bytes=3000, **limits).collect()}
        assert got == want
    # What blocks say of their hot anchors' strings: some twenty bytes for a byte of text at most, not a hundred for each way to lay a string over an anchor.
    docs, texts = pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])
    table = pa.table({"block": pa.array([0] * len(rows)), "rank": docs, "text": texts})
    block = substrings.Block.read(table)
    one = np.ones(len(block.keys), bool)
    shared = substrings.packed_rows([(0, 0, 1, substrings.bits(one, one))])
    around = substrings._tell_surroundings(1)(table, shared)
    first = pa.concat_tables([substrings._around_finder(0)(around.filter(pc.equal(around["bucket"], k))) for k in pc.unique(around["bucket"]).to_pylist()])
    sent = substrings._tell_strings(1)(table, pa.concat_tables([shared, first]))
    assert sum(len(p) for p in sent["payload"].to_pylist()) < 26 * sum(len(t) for _, t in rows)


def test_substrings_awkward(spark, frame, awkward):
    got = substrings.remove_repeats(frame(awkward), with_text=True).collect()
    assert len(got) == len(awkward)
    removed = {r.doc_id: r.n_removed for r in got}
    assert removed[5] == 0 and removed[6] > 0 and removed[8] == removed[1] == 0
    assert substrings.remove_repeats(frame([])).count() == 0


def test_suffix_sort_survives_hash_collisions(monkeypatch):
    rng = np.random.default_rng(2)
    chars = rng.integers(97, 99, (300, 12)).astype(np.uint8)
    length, group = rng.integers(0, 13, 300), rng.integers(0, 4, 300)
    chars[np.arange(12) >= length[:, None]] = 0
    monkeypatch.setattr(substrings, "mix64", lambda x: np.zeros_like(x))
    order, extension = substrings.suffix_sort(group, chars, length)
    monkeypatch.undo()
    good, exact = substrings.suffix_sort(group, chars, length)
    text = [(group[i], bytes(chars[i, : length[i]])) for i in range(300)]
    assert [text[i] for i in order] == [text[i] for i in good] == sorted(text)
    assert extension.tolist() == exact.tolist()


def test_passages(spark, frame, words, awkward):
    shared = [words(55 + 5 * k, 900 + k) for k in range(4)]
    rows = [(i, " ".join(words(40, i) + (shared[i % 4] if i % 3 == 0 else []) + words(30, 500 + i))) for i in range(60)]
    edited = list(shared[0])
    edited[3] = "edited"
    rows += [(200, " ".join(words(20, 77) + edited + words(20, 78))), (201, " ".join(words(30, 79) + shared[1][:30] + words(30, 80)))]
    got = {r.doc_id: r.class_id for r in passages.passage_classes(frame(rows), block_bytes=4000).collect()}
    want = {i: i for i, _ in rows}
    for k in range(4):
        own = [i for i in range(60) if i % 3 == 0 and i % 4 == k]
        want |= {i: min(own) for i in own}
    assert got == want | {200: want[0]}
    assert {r.doc_id: r.class_id for r in passages.passage_classes(frame(awkward)).collect() if r.class_id != r.doc_id} == {6: 5}
    assert passages.passage_classes(frame([])).count() == 0


def brute_lines(rows) -> dict:
    def near(a, b):
        if a == b:
            return True
        if len(a) < 5 or len(b) < 5 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    seen, out = [], {}
    for d, t in sorted(rows):
        gone = []
        for n, line in enumerate((t or "").split("\n")):
            w = WORD.findall(line)
            if w and any(near(w, x) for x in seen):
                gone.append(str(n))
            if w:
                seen.append(w)
        out[d] = (len((t or "").split("\n")), len(gone), ",".join(gone))
    return out


def test_lines_against_all_pairs(spark, frame, words, awkward):
    rng, rows = random.Random(8), []
    pool = [words(rng.randint(1, 12), 300 + i) for i in range(25)]
    for d in range(60):
        made = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(pool))
            change = rng.random()
            if change < 0.3:
                w[rng.randrange(len(w))] = f"new{d}"
            elif change < 0.5:
                w.insert(rng.randint(0, len(w)), f"more{d}")
            elif change < 0.6 and len(w) > 1:
                del w[rng.randrange(len(w))]
            made.append("  ".join(w))
        rows.append((d, "\n".join(made) if made else None))
    drops = lines.line_drops(frame(rows))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in drops.collect()}
    assert got == brute_lines(rows)
    kept = {r.doc_id: r.text for r in lines.kept_texts(frame(rows), drops).collect()}
    assert all(len(kept[d].split("\n")) == max(1, n - k) for d, (n, k, _) in got.items())
    awk = {r.doc_id: r.dropped for r in lines.line_drops(frame(awkward)).collect()}
    assert awk[10] == "1,2,3,4" and awk[8] == "0" and awk[7] == "" and awk[1] == ""
    assert lines.line_drops(frame([])).count() == 0


def test_a_very_long_line(spark, frame, words):
    """Lines of 100,000 words cost one pass each, and near ones are found wherever the word is."""
    long = words(100_000, 3)
    rows = [(k, " ".join([*long[:at], *new, *long[at + 1 :]])) for k, (at, new) in enumerate([(0, long[:1]), (0, ["x"]), (50_000, []), (99_999, ["y", "z"]), (70_000, ["a", "b", "c"])])]
    assert {r.doc_id: r.dropped for r in lines.line_drops(frame(rows)).collect()} == {0: "", 1: "0", 2: "0", 3: "", 4: ""}


def test_lines_of_few_words(spark, frame):
    """With another least number of words short lines are near ones too."""
    rows = [(0, "a b"), (1, "a c"), (2, "x"), (3, "d e f"), (4, "d f"), (5, "g h i j")]
    got = {r.doc_id: r.n_dropped for r in lines.line_drops(frame(rows), least_words=2).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0}
