"""Near-duplicate passages, by compact windows over token min-hashes.

Tokens are runs of five words; a passage is PASSAGE of them. Two passages are near-duplicates if LEAST_SHARED tokens
agree in order and stand in at most two blocks in each: so many agree at 0.8, and a word changed, added or dropped inside
a passage costs four or five tokens, so a second one is beyond the limit; what differs at the ends costs one by one.
The longer block of such a pair is a common run of at least CORE tokens.

For each of HASHES hash functions, a position is the centre of a compact window if it has the least hash in some run of
CORE tokens: a node of the Cartesian tree over the hashes whose subtree is that long. A common run of CORE tokens has
the same centres on both sides under every function, which makes the search complete:

1. Which keys (hash function, centre's token) stand in several documents?
2. In each document, an interval join across the hash functions: a run of CORE tokens stays if the centre of
   every function's window over it is shared. Of the first function's centres in such runs a hash of the tokens around
   goes out; equal surroundings link a document to the first that has them.
3. Different surroundings of one key meet by the hashes of what a near-duplicate pair has in common: LEAST_SHARED tokens
   in one block, or in two. Rows are sorted by such hashes and linked to their neighbours, token by token
   verified, so a group costs its rows and not its pairs.

Linked documents form classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import Texts, durable, mix64, powers, whole, word_spans
from priorline.llm.components import components
from priorline.llm.dealing import BITS, PACKED, answers_of, bits, block_number, bucket_of, dealt, find_shared, packed, packed_rows, unbits

WORDS = 50
SHINGLE = 5
PASSAGE = WORDS - SHINGLE + 1
LEAST_OVERLAP = 0.8
#: Tokens that two passages share at that overlap, and may each have besides.
LEAST_SHARED = -(-8 * PASSAGE // 9)
SPARE = PASSAGE - LEAST_SHARED
CORE = -(-LEAST_SHARED // 2)
HASHES = 4
SIDE = PASSAGE - 1
_WIDTH = SIDE + PASSAGE
BLOCK_BYTES = 4 << 20
STEP = 1 << 19
KEYS_A_TASK = 400_000
HOT_BLOCKS = 256
#: Columns that are gone over with one choice of rows.
STEP_COLUMNS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def tokens_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of five words, ASCII letters without case; and where each row's runs start and stop."""
    start, stop, row = word_spans(texts)
    n = len(texts.data)
    sums = np.zeros(n + 1, np.uint64)
    up = powers(n + 1)
    np.cumsum((_LOWER[texts.data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    down = powers(n + 1, _UNBASE)
    word = mix64((sums[stop] - sums[start]) * down[start] ^ (stop - start).astype(np.uint64))
    made = np.zeros(max(len(word) - SHINGLE + 1, 0), np.uint64)
    for k, weight in enumerate(mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64))):
        made += word[k : k + len(made)] * weight
    rows = np.arange(len(texts.start))
    first, last = np.searchsorted(row, rows), np.searchsorted(row, rows, "right")
    count = np.maximum(last - first - SHINGLE + 1, 0)
    inside = np.zeros(len(made) + 1, np.int32)
    np.add.at(inside, first[count > 0], 1)
    np.add.at(inside, (first + count)[count > 0], -1)
    ends = np.cumsum(count)
    return mix64(made[np.cumsum(inside)[: len(made)] > 0]), ends - count, ends


def least_in_run(values: np.ndarray, length: int = CORE) -> np.ndarray:
    """For each place, the least value of the run of so many that starts there; runs past the end are cut."""
    low, have = values.copy(), 1
    while have < length:
        s = min(have, length - have)
        low[:-s] = np.minimum(low[:-s], low[s:])
        have += s
    return low


def centres(values: np.ndarray, low: np.ndarray, runs: np.ndarray, length: int = CORE) -> np.ndarray:
    """Places with the least value of some run that `runs` marks the start of."""
    high, have = np.where(runs, low, 0).astype(np.uint64), 1
    while have < length:
        s = min(have, length - have)
        high[s:] = np.maximum(high[s:], high[:-s])
        have += s
    return np.flatnonzero((high == values) & (high > 0))


def _values(tokens: np.ndarray, function: int) -> np.ndarray:
    """A function's hashes: even and above zero, so that the last bit is free."""
    return (mix64(tokens ^ np.uint64((function + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) | np.uint64(2)) & ~np.uint64(1)


@dataclass
class Block:
    """A block's tokens with the centres of all hash functions; keys are its distinct keys in ascending order."""

    docs: np.ndarray
    tokens: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    runs: np.ndarray
    at: np.ndarray
    function: np.ndarray
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
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        parts, starts, stops, base, first = [np.zeros(0, np.uint64)], [], [], 0, 0
        while first < len(docs):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + STEP, "right")) - 1)
            made, a, b = tokens_of(Texts(raw[ends[first] : ends[last]], ends[first:last] - ends[first], ends[first + 1 : last + 1] - ends[first], slice(first, last)))
            parts.append(made)
            starts.append(a + base)
            stops.append(b + base)
            base += len(made)
            first = last
        start, stop = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, stops))
        tokens = np.concatenate(parts)
        edge = np.zeros(len(tokens) + 1, np.int32)
        long = stop - start >= PASSAGE
        np.add.at(edge, start[long], 1)
        np.add.at(edge, stop[long] - CORE + 1, -1)
        runs = np.cumsum(edge)[: len(tokens)] > 0
        at, function, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for f in range(HASHES if len(tokens) else 0):
            values = _values(tokens, f)
            places = centres(values, least_in_run(values), runs)
            at.append(places)
            function.append(np.full(len(places), f))
            key.append((mix64(values[places] + np.uint64(f)) >> (np.uint64(64) - BITS)) + np.uint64(1))
        places = np.concatenate(at)
        keys, key_of = np.unique(np.concatenate(key), return_inverse=True)
        return cls(docs[order], tokens, start, stop, runs, places, np.concatenate(function), np.searchsorted(stop, places, "right"), keys, key_of)

    def shared_here(self) -> np.ndarray:
        ids = self.docs[self.row] if len(self.row) else self.row
        least, most = np.full(len(self.keys), np.iinfo(np.int64).max), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(least, self.key_of, ids)
        np.maximum.at(most, self.key_of, ids)
        return least < most

    def alive(self, shared: np.ndarray) -> np.ndarray:
        """The interval join: the first function's centres (places in `at`) of runs over which all functions' centres are shared."""
        runs, low = self.runs.copy(), self.runs
        for f in range(HASHES - 1, -1, -1):
            own = self.function == f
            values = _values(self.tokens, f)
            told = values.copy()
            told[self.at[own]] |= shared[self.key_of[own]].astype(np.uint64)
            low = least_in_run(told)
            runs &= (low & np.uint64(1)) > 0
        first = np.flatnonzero(self.function == 0)
        chosen = np.zeros(len(self.tokens), bool)
        chosen[centres(values, low & ~np.uint64(1), runs)] = True
        # Of a stretch of one token (a word over and over) the ends will do: a common run that has both this token and another
        # has an end of the stretch, and two stretches may as well be laid end to end as in any other way.
        equal = np.concatenate(([False], self.tokens[1:] == self.tokens[:-1], [False]))
        equal[self.start] = False
        equal[self.stop] = False
        chosen &= ~(equal[:-1] & equal[1:])
        return first[chosen[self.at[first]]]


def _name(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A key for one part of a key's entries."""
    return (mix64(key ^ mix64(part)) >> (np.uint64(64) - BITS)) + np.uint64(1)


@dataclass
class Entries:
    """Distinct (key, surroundings) of the centres that the interval join keeps, each with its first document."""

    block: Block
    occurrence: np.ndarray
    entry: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    key: np.ndarray
    around: np.ndarray
    least: np.ndarray
    bucket: np.ndarray
    base: np.ndarray
    hot: np.ndarray

    @classmethod
    def of(cls, block: Block, replies: pa.Table, buckets: int) -> Entries:
        shared, hot = np.zeros(len(block.keys), bool), np.zeros(len(block.keys), bool)
        answers = answers_of(replies, 1)
        for k, own in dealt(bucket_of(block.keys, buckets)):
            shared[own], hot[own] = unbits(answers[k], own.stop - own.start)
        chosen = block.alive(shared) if len(block.tokens) else np.zeros(0, np.int64)
        at, row, keys = block.at[chosen], block.row[chosen], block.keys[block.key_of[chosen]]
        left = np.minimum(at - block.start[row], SIDE) if len(at) else at
        right = np.minimum(block.stop[row] - at, PASSAGE) if len(at) else at
        sums = np.zeros(len(block.tokens) + 1, np.uint64)
        np.cumsum(block.tokens * powers(len(block.tokens)), out=sums[1:])
        down = powers(len(sums), _UNBASE)
        lo, hi = at - left, at + right
        around = mix64(((sums[hi] - sums[lo]) * down[lo]) ^ (left * 64 + right).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        # A hot key's entries are dealt by their surroundings; in step 3 they meet in pairs of sub-groups.
        is_hot = hot[block.key_of[chosen]] if len(chosen) else np.zeros(0, bool)
        base = keys
        keys = np.where(is_hot, _name(keys, around), keys)
        bucket = bucket_of(keys, buckets)
        ids = block.docs[row] if len(row) else row
        by = np.lexsort((at, ids, around, keys, bucket))
        new = np.ones(len(by), bool)
        if len(by):
            new[1:] = (keys[by][1:] != keys[by][:-1]) | (around[by][1:] != around[by][:-1])
        entry = np.zeros(len(by), np.int64)
        entry[by] = np.cumsum(new) - 1
        first = by[new]
        return cls(block, chosen, entry, left, right, first, keys[first], around[first], ids[first], bucket[first], base[first], is_hot[first])


class Parts:
    """Which documents are connected so far: a forest of labels, joined in bulk."""

    def __init__(self, doc: np.ndarray) -> None:
        names, self.of = np.unique(doc, return_inverse=True)
        self.label = np.arange(len(names))

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return self.label[self.of[rows]]

    def join(self, one: np.ndarray, two: np.ndarray) -> None:
        while len(one):
            a, b = self[one], self[two]
            apart = a != b
            one, two = one[apart], two[apart]
            np.minimum.at(self.label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


class Surroundings:
    """Rows of tokens with their centre in column SIDE, read from left to right or from right to left."""

    def __init__(self, key: np.ndarray, left: np.ndarray, right: np.ndarray, tokens: np.ndarray, flipped: bool = False) -> None:
        self.tokens = np.ascontiguousarray((tokens[:, ::-1] if flipped else tokens).T)
        self.before, self.after = (right - 1, left + 1) if flipped else (left, right)
        self.key = mix64(key)
        self.sums = np.zeros((_WIDTH + 1, len(key)), np.uint64)
        for k, power in enumerate(powers(_WIDTH)):
            self.sums[k + 1] = self.sums[k] + mix64(self.tokens[k]) * power
        self.undo = powers(_WIDTH + 1, _UNBASE)

    def code(self, rows: np.ndarray, begin: int | np.ndarray, end: int | np.ndarray) -> np.ndarray:
        """A hash of key and of the columns begin to end, counted from the centre."""
        a, b = SIDE + begin, SIDE + end
        return mix64((self.sums[b, rows] - self.sums[a, rows]) * self.undo[a] ^ self.key[rows])

    def common(self, rows: np.ndarray, begin: int, end: int, parts: Parts) -> np.ndarray:
        """The rows that have these columns in common with a row of a document that isn't connected with theirs yet."""
        rows = rows[(self.before[rows] >= -begin) & (self.after[rows] >= end)]
        return rows[_mixed(self.code(rows, begin, end), parts[rows])]

    def same(self, one: np.ndarray, two: np.ndarray, first: np.ndarray, second: np.ndarray, length: int) -> np.ndarray:
        """Which pairs of rows have equal tokens from the given columns on."""
        k = np.arange(length)[:, None] + SIDE
        return (self.tokens[first + k, one] == self.tokens[second + k, two]).all(axis=0)


def _grouped(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts codes, where groups of equal ones begin, and for each place its group."""
    order = np.argsort(code)
    new = np.concatenate(([True], code[order][1:] != code[order][:-1])) if len(code) else np.zeros(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _mixed(code: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Which rows belong to a group of equal codes in which each of the values differs between some rows."""
    if not len(code):
        return np.zeros(0, bool)
    order, begin, group = _grouped(code)
    out = np.ones(len(begin), bool)
    for x in values:
        x = x[order]
        out &= np.minimum.reduceat(x, begin) != np.maximum.reduceat(x, begin)
    told = np.zeros(len(code), bool)
    told[order] = out[group]
    return told


def _neighbours(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, _, group = _grouped(code)
    at = np.flatnonzero(group[1:] == group[:-1])
    return order[at], order[at + 1]


def _from(reach: int, r: int, step: int) -> tuple[int, int]:
    """Columns that any run over the centre has which ends r columns on and is `reach` long, for r and the rest of its
    step: what lies on the longer side."""
    r -= r % step
    return (0, r) if 2 * r >= reach else (-max(0, reach - r - step + 1), 1)


def compare(key: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the documents of one key, enough to connect whatever all its pairs would connect."""
    parts, a, b = Parts(doc), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def link(one: np.ndarray, two: np.ndarray) -> None:
        a.append(doc[one])
        b.append(doc[two])
        parts.join(one, two)

    every = np.arange(len(key))
    view = Surroundings(key, left, right, tokens)
    for r in range(1, LEAST_SHARED + 1):
        if r == 1 or r % STEP_COLUMNS == 0:
            rows = view.common(every, *_from(LEAST_SHARED, r, STEP_COLUMNS), parts)
        own = rows[(view.before[rows] >= LEAST_SHARED - r) & (view.after[rows] >= r)]
        one, two = _neighbours(view.code(own, r - LEAST_SHARED, r))
        one, two = own[one], own[two]
        apart = parts[one] != parts[two]
        one, two = one[apart], two[apart]
        begin = np.full(len(one), r - LEAST_SHARED)
        true = view.same(one, two, begin, begin, LEAST_SHARED)
        link(one[true], two[true])
    for flipped in (False, True):
        view = Surroundings(key, left, right, tokens, True) if flipped else view
        for r in range(1, LEAST_SHARED):
            if r == 1 or r % STEP_COLUMNS == 0:
                rows = view.common(every, *_from(CORE, r, STEP_COLUMNS), parts)
            for one, two in _across(view, rows, r, parts):
                link(one, two)
    return np.concatenate(a), np.concatenate(b)


def _across(view: Surroundings, rows: np.ndarray, r: int, parts: Parts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between rows whose common run over the centre breaks off r columns on and goes on up to SPARE columns later.

    Only groups go on in which the run really breaks there, and in which tokens behind the break are common.
    """
    least = max(0, CORE - r)
    own = rows[(view.before[rows] >= least) & (view.after[rows] > r)]
    code = view.code(own, -least, r)
    told = _mixed(code, view.tokens[SIDE + r, own], parts[own])
    own, code = own[told], code[told]
    gap = np.repeat(np.arange(SPARE + 1), len(own))
    own, code = np.tile(own, SPARE + 1), np.tile(code, SPARE + 1)
    most = min(CORE - 1, LEAST_SHARED - r)
    for low in range(1, most + 1, STEP_COLUMNS):
        # So many tokens are common behind the break, and before it as many as go with the most of this step.
        high = min(low + STEP_COLUMNS - 1, most)
        fits = view.after[own] >= r + gap + low
        own, gap, code = own[fits], gap[fits], code[fits]
        told = _mixed(mix64(code + view.code(own, r + gap, r + gap + low) * np.uint64(3)), parts[own])
        own, gap, code = own[told], gap[told], code[told]
        l = LEAST_SHARED - r - high
        at = np.flatnonzero(view.before[own] >= l)
        near = mix64(view.code(own[at], -l, r) + view.code(own[at], r + gap[at], r + gap[at] + low) * np.uint64(3))
        at = at[_mixed(near, parts[own[at]])]
        for m in range(low, high + 1):
            l = LEAST_SHARED - r - m
            fits = at[(view.before[own[at]] >= l) & (view.after[own[at]] >= r + gap[at] + m)]
            if not len(fits):
                continue
            who, skip = own[fits], gap[fits]
            one, two = _neighbours(mix64(view.code(who, -l, r) + view.code(who, r + skip, r + skip + m) * np.uint64(3)))
            apart = parts[who[one]] != parts[who[two]]
            one, two = one[apart], two[apart]
            begin = np.full(len(one), -l)
            true = view.same(who[one], who[two], begin, begin, l + r) & view.same(who[one], who[two], r + skip[one], r + skip[two], m)
            yield who[one[true]], who[two[true]]


def _links(a: np.ndarray, b: np.ndarray) -> pa.Table:
    pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.table({"a": pa.array(pairs[:, 0].copy(), pa.int64()), "b": pa.array(pairs[:, 1].copy(), pa.int64())})


def _tell_keys(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        block = Block.read(table)
        sent = (block.keys << np.uint64(1)) | block.shared_here().astype(np.uint64)
        return packed_rows([(k, block_number(table), 1, packed(sent[own])) for k, own in dealt(bucket_of(block.keys, buckets))])

    return run


def _tell_surroundings(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return packed_rows([])
        x = Entries.of(Block.read(table), replies, buckets)
        return packed_rows([(k, block_number(table), 2, x.key[own].tobytes() + x.around[own].tobytes() + x.least[own].tobytes()) for k, own in dealt(x.bucket)])

    return run


def _find_first(table: pa.Table) -> pa.Table:
    """For each entry the first document with these surroundings, and whether the key has others too."""
    parts = [np.frombuffer(p, np.uint64).reshape(3, -1) for p in table.column("payload").to_pylist()]
    key, around, least = (np.concatenate([p[i] for p in parts]) for i in range(3))
    least = least.view(np.int64)
    order = np.lexsort((least, around, key))
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[order][1:] != key[order][:-1]
    new = new_key.copy()
    new[1:] |= around[order][1:] != around[order][:-1]
    first = np.zeros(len(key), np.int64)
    first[order] = least[order][new][np.cumsum(new) - 1]
    several = np.zeros(len(key), bool)
    several[order] = (np.bincount((np.cumsum(new_key) - 1)[new]) > 1)[np.cumsum(new_key) - 1]
    ends = np.cumsum([p.shape[1] for p in parts])
    blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    return packed_rows([(bucket, b, 2, first[e - p.shape[1] : e].tobytes() + bits(several[e - p.shape[1] : e])) for b, p, e in zip(blocks, parts, ends, strict=True)])


def _answered(x: Entries, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    answers = answers_of(replies, 2)
    first, several = x.least.copy(), np.zeros(len(x.key), bool)
    for k, own in dealt(x.bucket):
        n = own.stop - own.start
        first[own] = np.frombuffer(answers[k], np.int64, n)
        several[own] = unbits(answers[k][8 * n :], n, 1)[0]
    return first, several


def _asking(x: Entries, ask: np.ndarray, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entries, their keys in ascending order): a hot key's entries stand in `parts` sub-groups, and every two of these
    have a key, so that any two entries meet and no key has more than two sub-groups."""
    cold, hot = ask[~x.hot[ask]], ask[x.hot[ask]]
    order = np.argsort(x.base[cold], kind="stable")
    yield cold[order], x.base[cold][order]
    own = (x.around[hot] % np.uint64(parts)).astype(np.int64)
    for other in range(parts if len(hot) else 0):
        pair = np.minimum(own, other) * parts + np.maximum(own, other)
        key = _name(x.base[hot], pair.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        yield hot[order], key[order]


def _tell_links(buckets: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Links to first documents with a whole common passage, and the tokens around first occurrences, in one table."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows and replies.num_rows:
            x = Entries.of(Block.read(table), replies, buckets)
            first, several = _answered(x, replies)
            ids = x.block.docs[x.block.row[x.occurrence]] if len(x.occurrence) else x.occurrence
            reach = x.left + x.right >= PASSAGE
            away = np.flatnonzero((ids != first[x.entry]) & reach) if len(x.entry) else np.zeros(0, np.int64)
            links = _links(ids[away], first[x.entry[away]])
            rows.append((-1 - block_number(table), block_number(table), 0, links.column("a").to_numpy().tobytes() + links.column("b").to_numpy().tobytes()))
            for e, key in _asking(x, np.flatnonzero((several | x.hot) & (first == x.least)), parts):
                bucket = bucket_of(key, buckets)
                for k, own in dealt(bucket):
                    o = x.first[e[own]]
                    at, left, right = x.block.at[x.occurrence[o]], x.left[o], x.right[o]
                    tokens = x.block.tokens[np.clip(at[:, None] + np.arange(-SIDE, PASSAGE), 0, len(x.block.tokens) - 1)].astype(np.uint32)
                    rows.append((k, block_number(table), 3, key[own].tobytes() + x.least[e[own]].tobytes() + left.astype(np.uint8).tobytes() + right.astype(np.uint8).tobytes() + tokens.tobytes()))
        return packed_rows(rows)

    return run


_ROW = 18 + 4 * _WIDTH


def _find_links(table: pa.Table) -> pa.Table:
    payloads = table.column("payload").to_pylist()
    if table.column("step")[0].as_py() == 0:
        pairs = [np.frombuffer(p, np.int64).reshape(2, -1) for p in payloads]
        return _links(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
    parts = []
    for p in payloads:
        n = len(p) // _ROW
        parts.append((np.frombuffer(p, np.uint64, n), np.frombuffer(p, np.int64, n, 8 * n), np.frombuffer(p, np.uint8, n, 16 * n), np.frombuffer(p, np.uint8, n, 17 * n), np.frombuffer(p, np.uint32, -1, 18 * n).reshape(n, -1)))
    key, doc, left, right, tokens = (np.concatenate([p[i] for p in parts]) for i in range(5))
    return _links(*compare(key, doc, left.astype(np.int64), right.astype(np.int64), tokens))


def passage_links(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """Links (a, b) between documents that share a near-duplicate passage, enough to connect all that do."""
    bodies = docs.select(F.col("doc_id").cast("long").alias("rank"), whole("text").alias("text")).filter("rank is not null")
    total = bodies.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, -(-total // block_bytes)), max(1, -(-total // (8 * KEYS_A_TASK)))
    salt = F.xxhash64("rank", F.octet_length("text"))
    by_block = bodies.select(F.pmod(salt, F.lit(blocks)).alias("block"), "rank", "text").repartition(blocks, "block").groupBy("block")
    shared = by_block.applyInArrow(_tell_keys(buckets), PACKED).groupBy("bucket").applyInArrow(find_shared(hot_blocks), PACKED)
    around = by_block.cogroup(shared.groupBy("block")).applyInArrow(_tell_surroundings(buckets), PACKED)
    told = shared.unionByName(around.groupBy("bucket").applyInArrow(_find_first, PACKED))
    sent = by_block.cogroup(told.groupBy("block")).applyInArrow(_tell_links(buckets, max(2, -(-blocks // max(hot_blocks, 1)))), PACKED)
    return sent.groupBy("bucket").applyInArrow(_find_links, "a long, b long")


def passage_classes(docs: DataFrame, **sizes: int) -> DataFrame:
    """(doc_id, class_id, n_others): a row for each row of docs.

    class_id is the smallest doc_id that its links reach, its own without a link; n_others counts the other documents of
    the class. Defined cases: null and short texts (under WORDS words) have no passage; a row without doc_id
    can't be named by a link, so its class_id is null; rows with one doc_id are one document; an empty table gives
    no rows; other columns are ignored. Links are complete: see the module's first lines.
    """
    links = durable(passage_links(docs, **sizes).distinct())
    roots = components(links)
    sizes_of = roots.groupBy("root").agg((F.count(F.lit(1)) - 1).alias("n_others")).withColumnRenamed("root", "_root")
    placed = roots.join(sizes_of, F.col("root") == F.col("_root")).select("node", "root", "n_others")
    ids = docs.select("doc_id").join(placed, F.col("doc_id").cast("long") == F.col("node"), "left")
    return ids.select("doc_id", F.coalesce("root", F.col("doc_id").cast("long")).alias("class_id"), F.coalesce("n_others", F.lit(0)).cast("long").alias("n_others"))
