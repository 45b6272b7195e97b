"""Exact substring dedup over all documents, by a sparse suffix sort whose comparisons use hashes.

Every 50-byte string has an anchor: its 16-byte gram with the least hash. Two documents that share the
string share the anchor, at the same place in it. So only anchors travel between documents:

1. Which anchors stand in several documents? Hashes go out, two bits each come back.
2. Which of those stand in the same surroundings (all bytes that a 50-byte string over the anchor can
   cover)? A hash of them goes out, two bits come back; all but the first document are then settled.
3. Of each surroundings the first document's bytes go out. Around one anchor they are sorted as suffixes (what
   follows the anchor) and as reversed prefixes, by a mergesort whose comparisons find the common extension
   by binary search on prefix polynomial hashes. Runs of the two orders with a long enough common
   extension are the strings that are equal; the extensions are checked byte by byte. Of an anchor in very many
   blocks, which no task could sort, only its own strings go out, as hashes, and one bit comes back for each.

Texts are dealt to blocks once; each step reads a block again and recomputes its anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import Texts, mix64, powers, whole
from priorline.llm.dealing import BITS, PACKED, answers_of, bits, block_number, bucket_of, dealt, find_shared, hashed, packed, packed_rows, unbits, unhashed

LENGTH = 50
GRAM = 16
REACH = LENGTH - GRAM
BLOCK_BYTES = 4 << 20
STEP = 1 << 18
KEYS_A_TASK = 400_000
#: An anchor in more blocks than this, or in more surroundings, is hot: those strings are sent of which it is the least gram,
#: each as 112 bits of hash. That costs more than surroundings do, so the limits are what one task can sort.
HOT_BLOCKS = 4096
MOST_AROUND = 20_000
STRING_BUCKETS = 4
_POWERS = powers(2 * STEP)
_UNDO = powers(2 * STEP, np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
_BASES = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_MIXED = mix64(np.arange(1, 257, dtype=np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _UNDO
    if n > len(_POWERS):
        _POWERS = powers(2 * n)
        _UNDO = powers(2 * n, np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
    return _POWERS, _UNDO


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _tables(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def anchors(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes (1 to 2**48) of all grams that have the least hash in a string within one row; ties all count."""
    n = len(data) - GRAM + 1
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = _sums(data)
    h = (mix64((sums[GRAM:] - sums[:-GRAM]) * _tables(len(sums))[1][:n]) >> (np.uint64(64) - BITS)) + np.uint64(1)
    low, have = h.copy(), 1
    while have < REACH + 1:
        s = min(have, REACH + 1 - have)
        low[:-s] = np.minimum(low[:-s], low[s:])
        have += s
    edge = np.zeros(len(data) + 1, np.int32)
    long = stop - start >= LENGTH
    edge[start[long]] += 1
    edge[stop[long] - LENGTH + 1] -= 1
    low[np.cumsum(edge)[:n] <= 0] = 0
    have = 1
    while have < REACH + 1:
        s = min(have, REACH + 1 - have)
        low[s:] = np.maximum(low[s:], low[:-s])
        have += s
    at = np.flatnonzero(low == h)
    # Least hashes crowd at zero; scrambled again they spread evenly over the buckets.
    return at, (mix64(h[at]) >> (np.uint64(64) - BITS)) + np.uint64(1)


def _steps(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about STEP bytes."""
    first, n = 0, len(start)
    while first < n:
        last = max(first + 1, int(np.searchsorted(stop, start[first] + STEP, "right")))
        yield first, last
        first = last


@dataclass
class Block:
    """A block's documents with their anchors; keys are its distinct anchors in ascending order."""

    docs: np.ndarray
    texts: Texts
    at: np.ndarray
    row: np.ndarray
    keys: np.ndarray
    key_of: np.ndarray

    @classmethod
    def read(cls, table: pa.Table) -> Block:
        docs = np.asarray(table.column("rank").to_numpy(), np.int64)
        order = np.argsort(docs, kind="stable")
        bodies = table.column("text").combine_chunks().cast(pa.large_binary()).take(pa.array(order))
        if isinstance(bodies, pa.ChunkedArray):
            bodies = bodies.combine_chunks()
        _, offsets, data = bodies.buffers()
        ends = np.frombuffer(offsets, np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        texts = Texts(raw, ends[:-1] - ends[0], ends[1:] - ends[0], slice(0, len(bodies)))
        at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, b in _steps(texts.start, texts.stop):
            base = texts.start[a]
            places, found = anchors(raw[base : texts.stop[b - 1]], texts.start[a:b] - base, texts.stop[a:b] - base)
            at.append(places + base)
            hashes.append(found)
        places = np.concatenate(at)
        keys, key_of = np.unique(np.concatenate(hashes), return_inverse=True)
        return cls(docs[order], texts, places, np.searchsorted(texts.stop, places, "right"), keys, key_of)

    def shared_here(self) -> np.ndarray:
        """Which keys stand in two documents of the block."""
        ids = self.docs[self.row]
        least, most = np.full(len(self.keys), np.iinfo(np.int64).max), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(least, self.key_of, ids)
        np.maximum.at(most, self.key_of, ids)
        return least < most


@dataclass
class Repeats:
    """A block's anchors that stand in several documents, and their distinct (key, surroundings), here called entries."""

    block: Block
    at: np.ndarray
    row: np.ndarray
    left: np.ndarray
    right: np.ndarray
    entry: np.ndarray
    key: np.ndarray
    around: np.ndarray
    least: np.ndarray
    hot: np.ndarray
    bucket: np.ndarray

    @classmethod
    def of(cls, block: Block, replies: pa.Table, buckets: int) -> Repeats:
        shared, hot = np.zeros(len(block.keys), bool), np.zeros(len(block.keys), bool)
        answers = answers_of(replies, 1)
        for k, own in dealt(bucket_of(block.keys, buckets)):
            shared[own], hot[own] = unbits(answers[k], own.stop - own.start)
        mine = np.flatnonzero(shared[block.key_of])
        order = mine[np.argsort(block.at[mine], kind="stable")]
        at, row, keys = block.at[order], block.row[order], block.keys[block.key_of[order]]
        texts = block.texts
        left = np.minimum(at - texts.start[row], REACH) if len(at) else at
        right = np.minimum(texts.stop[row] - at, LENGTH) if len(at) else at
        around = np.zeros(len(at), np.uint64)
        for a, b in _steps(texts.start, texts.stop):
            base = texts.start[a]
            own = slice(*np.searchsorted(at, [base, texts.stop[b - 1]]))
            if own.stop > own.start:
                sums = _sums(texts.data[base : texts.stop[b - 1]])
                lo, hi = at[own] - left[own] - base, at[own] + right[own] - base
                around[own] = mix64(((sums[hi] - sums[lo]) * _tables(len(sums))[1][lo]) ^ (left[own] * 64 + right[own]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        is_hot = hot[block.key_of[order]] if len(order) else np.zeros(0, bool)
        bucket = np.where(is_hot, mix64(keys ^ around) % np.uint64(buckets), bucket_of(keys, buckets).astype(np.uint64)).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        ids = block.docs[row] if len(at) else at
        by = np.lexsort((at, ids, around, keys, bucket))
        new = np.ones(len(by), bool)
        if len(by):
            new[1:] = (keys[by][1:] != keys[by][:-1]) | (around[by][1:] != around[by][:-1])
        entry = np.zeros(len(by), np.int64)
        entry[by] = np.cumsum(new) - 1
        first = by[new]
        return cls(block, at, row, left, right, entry, keys[first], around[first], ids[first], is_hot[first], bucket[first])


def _request(repeats: Repeats, replies: pa.Table) -> tuple[np.ndarray, ...]:
    """(settled, each entry's first occurrence, entries sent whole, entries sent as strings), the last two sorted by bucket."""
    answers = answers_of(replies, 2)
    settled, several, crowded = (np.zeros(len(repeats.key), bool) for _ in range(3))
    for k, own in dealt(repeats.bucket):
        settled[own], several[own], crowded[own] = unbits(answers[k], own.stop - own.start, 3)
    first = np.full(len(repeats.key), -1, np.int64)
    ids = repeats.block.docs[repeats.row] if len(repeats.row) else repeats.row
    mine = np.flatnonzero(ids == repeats.least[repeats.entry]) if len(repeats.entry) else np.zeros(0, np.int64)
    first[repeats.entry[mine][::-1]] = mine[::-1]
    ask = np.flatnonzero(~settled & several)
    return settled, first, ask[~crowded[ask]], ask[crowded[ask]]


def own_strings(chars: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and most bytes before the anchor at which a string starts that has no lesser gram, from surroundings."""
    places = 2 * REACH + 1
    code = np.zeros((len(chars), places), np.uint64)
    for j in range(GRAM):
        code += (chars[:, j : j + places].astype(np.uint64) + np.uint64(1)) * _POWERS[j]
    code = mix64(code) >> (np.uint64(64) - BITS)
    at = np.arange(-REACH, REACH + 1)
    lesser = (code < code[:, REACH : REACH + 1]) & (at >= -left[:, None]) & (at + GRAM <= right[:, None])
    before, after = lesser[:, :REACH][:, ::-1], lesser[:, REACH + 1 :]
    free = [np.where(x.any(axis=1), x.argmax(axis=1), REACH) for x in (before, after)]
    return np.maximum(REACH - free[1], LENGTH - right), np.minimum(free[0], left)


@dataclass
class HotStrings:
    """A block's distinct strings over hot anchors: two hashes and the smallest document; which one each (entry, back) is."""

    bucket: np.ndarray
    key: np.ndarray
    other: np.ndarray
    doc: np.ndarray
    entry: np.ndarray
    back: np.ndarray
    which: np.ndarray

    @classmethod
    def of(cls, x: Repeats, first: np.ndarray, hot: np.ndarray, buckets: int) -> HotStrings:
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        width = REACH + LENGTH
        weights = [(powers(width, b), powers(width, np.uint64(pow(int(b), -1, 1 << 64)))) for b in _BASES]
        for a in range(0, len(hot), 1 << 12):
            entry = hot[a : a + (1 << 12)]
            o = first[entry]
            chars = _surroundings(x.block.texts.data, x.at[o], x.left[o], x.right[o])
            low, high = own_strings(chars, x.left[o], x.right[o])
            row = np.repeat(np.arange(len(o)), np.maximum(high - low + 1, 0))
            back = np.arange(len(row)) - np.searchsorted(row, row) + low[row]
            hashes, mixed = [], _MIXED[chars]
            for up, down in weights:
                sums = np.zeros((len(o), width + 1), np.uint64)
                np.cumsum(mixed * up, axis=1, out=sums[:, 1:])
                hashes.append(mix64((sums[row, width - back] - sums[row, REACH - back]) * down[REACH - back]))
            found.append(((hashes[0] >> (np.uint64(64) - BITS)) + np.uint64(1), hashes[1], entry[row], back))
        key, other, entry, back = (np.concatenate(v) for v in zip(*found, strict=True))
        by = np.lexsort((x.least[entry], other, key))
        new = np.ones(len(by), bool)
        new[1:] = (key[by][1:] != key[by][:-1]) | (other[by][1:] != other[by][:-1])
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        one = by[new]
        # Strings have finer buckets than anchors, behind theirs: there are some twenty of them for an anchor.
        return cls(buckets + bucket_of(key[one], STRING_BUCKETS * buckets), key[one], other[one], x.least[entry[one]], entry, back, which)


def _surroundings(data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bytes around each anchor, the anchor in column REACH; zero where there are none."""
    columns = np.arange(-REACH, LENGTH)
    inside = (columns >= -left[:, None]) & (columns < right[:, None])
    places = np.clip(at[:, None] + columns, 0, max(len(data) - 1, 0))
    return np.where(inside, data[places], 0).astype(np.uint8)


def common(sums: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The common extension of strings i and j: binary search for the longest prefix with one hash."""
    low, high = np.zeros(len(i), np.int64), np.minimum(length[i], length[j])
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = sums[i, middle] == sums[j, middle]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_sort(group: np.ndarray, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by group and string, and each string's common extension with the one before it (0 for a group's first).

    A mergesort from the bottom up: each element finds its place in the run next to its own by binary search,
    all elements at once. Each comparison takes a logarithmic number of hash comparisons.
    """
    n, width = chars.shape
    sums = np.zeros((n, width + 1), np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * mix64(powers(width)), axis=1, out=sums[:, 1:])
    order = np.argsort(group, kind="stable")
    new = np.ones(n, bool)
    new[1:] = group[order][1:] != group[order][:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    begin, size = np.repeat(begin, size), np.repeat(size, size)

    def before(i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        shared = common(sums, length, i, j)
        ends = shared == np.minimum(length[i], length[j])
        last = np.minimum(shared, width - 1)
        a, b = chars[i, last].astype(np.int16), chars[j, last].astype(np.int16)
        smaller = np.where(ends, length[i] < length[j], a < b)
        equal = ends & (length[i] == length[j])
        return smaller | (equal & or_equal)

    run = 1
    while n and run < size.max():
        place = np.flatnonzero(size > run)
        own = place - begin[place]
        number = own // run
        odd = number % 2 == 1
        other = np.where(odd, number - 1, number + 1) * run
        low = begin[place] + np.minimum(other, size[place])
        high = begin[place] + np.minimum(other + run, size[place])
        origin, element = low.copy(), order[place]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            ahead = before(order[middle], element[open_], odd[open_])
            low[open_] = np.where(ahead, middle + 1, low[open_])
            high[open_] = np.where(ahead, high[open_], middle)
        order[begin[place] + (number // 2) * 2 * run + own % run + (low - origin)] = element
        run *= 2
    extension = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        limit = np.minimum(length[a], length[b])
        differ = chars[a] != chars[b]
        exact = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), limit)
        if (exact != common(sums, length, a, b)).any():
            # Two different prefixes share a hash: the order by bytes replaces the one by hashes.
            order = np.lexsort((length, *chars.T[::-1], group))
            a, b = order[:-1], order[1:]
            limit, differ = np.minimum(length[a], length[b]), chars[a] != chars[b]
            exact = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), limit)
        extension[1:] = exact
    new = np.ones(n, bool)
    new[1:] = group[order][1:] != group[order][:-1]
    extension[new] = 0
    return order, extension


def repeated_strings(key: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """For each surroundings a mask: bit k if the string that starts k bytes before the anchor is in a smaller document too."""
    n = len(key)
    mask = np.zeros(n, np.uint64)
    if not n:
        return mask
    _, group = np.unique(key, return_inverse=True)
    after, longer = suffix_sort(group, chars[:, REACH:], right)
    back, earlier = suffix_sort(group, np.ascontiguousarray(chars[:, :REACH][:, ::-1]), left)
    new_after, new_back = np.ones(n, bool), np.ones(n, bool)
    new_after[1:] = group[after][1:] != group[after][:-1]
    new_back[1:] = group[back][1:] != group[back][:-1]
    a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(REACH + 1):
        own = np.flatnonzero((left >= k) & (right >= LENGTH - k))
        if len(own) < 2:
            continue
        a[after] = np.cumsum(new_after | (longer < LENGTH - k))
        b[back] = np.cumsum(new_back | (earlier < k))
        _, which = np.unique(a[own] * (n + 1) + b[own], return_inverse=True)
        least = np.full(which.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc[own])
        mask[own[least[which] < doc[own]]] |= np.uint64(1 << k)
    return mask


def covered(repeats: Repeats, replies: pa.Table, buckets: int) -> np.ndarray:
    """Which bytes of the block are removed."""
    texts = repeats.block.texts
    settled, first, plain, hot = _request(repeats, replies)
    mask = np.zeros(len(repeats.key), np.uint64)
    answers = answers_of(replies, 3)
    for k, own in dealt(repeats.bucket[plain]):
        mask[plain[own]] = np.frombuffer(answers[k], np.uint64)
    strings, answers = HotStrings.of(repeats, first, hot, buckets), answers_of(replies, 4)
    earlier = np.zeros(len(strings.key), bool)
    for k, own in dealt(strings.bucket):
        earlier[own] = unbits(answers[k], own.stop - own.start, 1)[0]
    gone = earlier[strings.which] | (strings.doc[strings.which] < repeats.least[strings.entry])
    np.bitwise_or.at(mask, strings.entry[gone], np.uint64(1) << strings.back[gone].astype(np.uint64))
    edge = np.zeros(len(texts.data) + 1, np.int32)
    if len(repeats.at):
        ids = repeats.block.docs[repeats.row]
        full = settled[repeats.entry] | (ids > repeats.least[repeats.entry])
        np.add.at(edge, (repeats.at - repeats.left)[full], 1)
        np.add.at(edge, (repeats.at + repeats.right)[full], -1)
        masks = np.where(full, np.uint64(0), mask[repeats.entry])
        for k in range(REACH + 1):
            at = repeats.at[(masks >> np.uint64(k)) & np.uint64(1) > 0] - k
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
    return np.cumsum(edge)[:-1] > 0


def _tell_keys(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        block = Block.read(table)
        sent = (block.keys << np.uint64(1)) | block.shared_here().astype(np.uint64)
        rows = []
        for k, own in dealt(bucket_of(block.keys, buckets)):
            rows.append((k, block_number(table), 1, packed(sent[own])))
        return packed_rows(rows)

    return run


def _tell_surroundings(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return packed_rows([])
        x = Repeats.of(Block.read(table), replies, buckets)
        rows = []
        for k, own in dealt(x.bucket):
            keys = (x.key[own] << np.uint64(1)) | x.hot[own].astype(np.uint64)
            rows.append((k, block_number(table), 2, hashed(keys, x.around[own], x.least[own])))
        return packed_rows(rows)

    return run


def _find_first(most_around: int, table: pa.Table) -> pa.Table:
    parts = [unhashed(p) for p in table.column("payload").to_pylist()]
    sent, around, least = (np.concatenate([p[i] for p in parts]) for i in range(3))
    key = sent >> np.uint64(1)
    order = np.lexsort((least, around, key))
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[order][1:] != key[order][:-1]
    new = new_key.copy()
    new[1:] |= around[order][1:] != around[order][:-1]
    entry, group = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    smallest = least[order][new]
    kinds = np.bincount(group[new])
    settled, several = np.zeros(len(key), bool), np.zeros(len(key), bool)
    settled[order] = least[order] > smallest[entry]
    several[order], crowded = kinds[group] > 1, np.zeros(len(key), bool)
    crowded[order] = kinds[group] > most_around
    hot = (sent & np.uint64(1)) > 0
    several, crowded = several | hot, crowded | hot
    sizes = np.array([len(p[0]) for p in parts])
    ends = np.cumsum(sizes)
    blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    return packed_rows([(bucket, b, 2, bits(settled[e - n : e], several[e - n : e], crowded[e - n : e])) for b, n, e in zip(blocks, sizes, ends, strict=True)])


def _around_finder(most_around: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        return _find_first(most_around, table)

    return run


_ROW = 8 + 8 + 1 + 1 + REACH + LENGTH


def _tell_strings(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return packed_rows([])
        x = Repeats.of(Block.read(table), replies, buckets)
        _, first, plain, hot = _request(x, replies)
        rows = []
        for k, own in dealt(x.bucket[plain]):
            entry = plain[own]
            at = first[entry]
            left, right = x.left[at], x.right[at]
            chars = _surroundings(x.block.texts.data, x.at[at], left, right)
            rows.append((k, block_number(table), 3, x.key[entry].tobytes() + x.least[entry].tobytes() + left.astype(np.uint8).tobytes() + right.astype(np.uint8).tobytes() + chars.tobytes()))
        strings = HotStrings.of(x, first, hot, buckets)
        for k, own in dealt(strings.bucket):
            rows.append((k, block_number(table), 4, hashed(strings.key[own], strings.other[own], strings.doc[own])))
        return packed_rows(rows)

    return run


def _find_earlier(table: pa.Table) -> pa.Table:
    """For each string whether a smaller document than the block's has it."""
    parts = [unhashed(p) for p in table.column("payload").to_pylist()]
    key, other, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
    by = np.lexsort((doc, other, key))
    new = np.ones(len(by), bool)
    new[1:] = (key[by][1:] != key[by][:-1]) | (other[by][1:] != other[by][:-1])
    earlier = np.zeros(len(by), bool)
    earlier[by] = doc[by] > doc[by[new]][np.cumsum(new) - 1]
    ends = np.cumsum([len(p[0]) for p in parts])
    blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    return packed_rows([(bucket, b, 4, bits(earlier[e - len(p[0]) : e])) for b, p, e in zip(blocks, parts, ends, strict=True)])


def _find_strings(table: pa.Table) -> pa.Table:
    if table.column("step")[0].as_py() == 4:
        return _find_earlier(table)
    parts = []
    for p in table.column("payload").to_pylist():
        n = len(p) // _ROW
        parts.append((np.frombuffer(p, np.uint64, n), np.frombuffer(p, np.int64, n, 8 * n), np.frombuffer(p, np.uint8, n, 16 * n), np.frombuffer(p, np.uint8, n, 17 * n), np.frombuffer(p, np.uint8, -1, 18 * n).reshape(n, -1)))
    key, doc, left, right, chars = (np.concatenate([p[i] for p in parts]) for i in range(5))
    mask = repeated_strings(key, doc, left.astype(np.int64), right.astype(np.int64), chars)
    ends = np.cumsum([len(p[0]) for p in parts])
    blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    return packed_rows([(bucket, b, 3, mask[e - len(p[0]) : e].tobytes()) for b, p, e in zip(blocks, parts, ends, strict=True)])


def _remove(buckets: int, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        texts_out = []
        if table.num_rows:
            block = Block.read(table)
            gone = covered(Repeats.of(block, replies, buckets), replies, buckets) if replies.num_rows else np.zeros(len(block.texts.data), bool)
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            texts = block.texts
            whole_rows = texts.start[texts.start < texts.stop]
            starts[whole_rows] = gone[whole_rows]
            for doc, a, b in zip(block.docs.tolist(), texts.start.tolist(), texts.stop.tolist(), strict=True):
                kept = texts.data[a:b][~gone[a:b]].tobytes()
                out["doc_id"].append(None if doc == np.iinfo(np.int64).max else doc)
                out["n_bytes"].append(b - a)
                out["n_removed"].append(b - a - len(kept))
                out["n_spans"].append(int(np.count_nonzero(starts[a:b])))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                texts_out.append(kept)
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
        made = {k: pa.array(v, kinds[k]) for k, v in out.items()}
        return pa.table(made | ({"kept": pa.array(texts_out, pa.binary())} if with_text else {}))

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS, most_around: int = MOST_AROUND) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) for each row.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id. Defined cases:
    a null text is empty; rows with one doc_id are equals, neither removes from the other; rows without doc_id
    come last; texts under 50 bytes stay whole; an empty table gives no rows; other columns are ignored.
    Blocks and buckets follow the corpus's size, so that a task's share doesn't grow with it.
    """
    bodies = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rank"), whole("text").alias("text"))
    total = bodies.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = max(1, -(-total // (16 * KEYS_A_TASK)))
    salt = F.xxhash64("rank", F.octet_length("text"), F.crc32(F.col("text").cast("binary")))
    dealt_out = bodies.select(F.pmod(salt, F.lit(blocks)).alias("block"), "rank", "text").repartition(blocks, "block")
    by_block = dealt_out.groupBy("block")
    keys = by_block.applyInArrow(_tell_keys(buckets), PACKED)
    shared = keys.groupBy("bucket").applyInArrow(find_shared(hot_blocks), PACKED)
    around = by_block.cogroup(shared.groupBy("block")).applyInArrow(_tell_surroundings(buckets), PACKED)
    first = around.groupBy("bucket").applyInArrow(_around_finder(most_around), PACKED)
    told = shared.unionByName(first)
    strings = by_block.cogroup(told.groupBy("block")).applyInArrow(_tell_strings(buckets), PACKED)
    found = strings.groupBy("bucket").applyInArrow(_find_strings, PACKED)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return by_block.cogroup(told.unionByName(found).groupBy("block")).applyInArrow(_remove(buckets, with_text), schema)
