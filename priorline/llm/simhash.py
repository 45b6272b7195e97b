"""SimHash near-duplicates, with pigeonring filtering of the pairs that are compared.

The 64 bits lie in five segments on a ring. If two fingerprints differ in at most four bits, there is a
segment from which every chain of consecutive segments keeps its proportional share of those four: none in
the first, at most one in the first two, two in three, three in four. The first two make a key (with one bit
of the second segment masked, for each bit in turn), so only rows that meet the first two budgets meet at
all; the longer chains prune the pairs again before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import durable, n_partitions, whole
from priorline.llm.components import components

SHINGLE = 4
MOST_BITS = 4
SEED = 42
#: Fixed: widths of the five segments, low bits first.
WIDTHS = (13, 13, 13, 13, 12)
#: Groups up to this size are compared pair by pair in one vectorised sweep.
SMALL_GROUP = 12
ROWS_A_TASK = 2_000_000


def fingerprint(text: bytes) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned number; no words give zero."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = min(SHINGLE, len(words))
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    first, last = starts[: len(words) - size + 1].tolist(), stops[size - 1 :].tolist()
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), 1 << 15):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first[at : at + (1 << 15)], last[at : at + (1 << 15)], strict=True)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The carried columns and fp, the fingerprint's bits as a signed long; a null text is an empty one."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(batch.num_columns - 1).cast(pa.binary())
            made = np.array([fingerprint(x.as_py()) for x in bodies], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made)], [*carry, "fp"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "fp long"])
    return docs.select(*carry, whole(text).alias("_text")).mapInArrow(run, schema)


def ring_keys(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint (rows) its chain keys (columns): start, masked bit, first segment, second masked."""
    at, segments = 0, []
    for width in WIDTHS:
        segments.append((fps >> np.uint64(at)) & np.uint64((1 << width) - 1))
        at += width
    columns = []
    for i in range(5):
        one, two = segments[i], segments[(i + 1) % 5]
        for bit in range(WIDTHS[(i + 1) % 5]):
            tag = np.uint64((i * 16 + bit) << 26)
            columns.append(tag | (one << np.uint64(13)) | (two & np.uint64(~(1 << bit) & 0x1FFF)))
    return np.stack(columns, axis=1)


def _chain_masks() -> np.ndarray:
    """For each start, the bits of three and of four segments in a row."""
    begin = np.concatenate(([0], np.cumsum(WIDTHS)))
    segment = [((1 << WIDTHS[i]) - 1) << int(begin[i]) for i in range(5)]
    return np.array([[sum(segment[(i + j) % 5] for j in range(n)) for n in (3, 4)] for i in range(5)], np.uint64)


CHAINS = _chain_masks()


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Which pairs keep the budgets of the chains from that start, and the full budget."""
    differ = a ^ b
    fits = np.bitwise_count(differ & CHAINS[start, 0]) <= 2
    fits &= np.bitwise_count(differ & CHAINS[start, 1]) <= 3
    return fits & (np.bitwise_count(differ) <= MOST_BITS)


def _forest(fps: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever a large group's pairs would connect: each member is reached once.

    A member is compared with those not yet reached only, so a dense group of near copies costs a pass or two,
    and no pair is left out that could join two parts.
    """
    rest = fps
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            one, front = front[0], front[1:]
            hit = linked(np.full(len(rest), one), rest, start)
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                yield np.full(len(found), one), found
                front = np.concatenate((front, found))


def group_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints that share a key."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(first, len(keys)))
    group = np.repeat(np.arange(len(first)), sizes)
    small = (sizes <= SMALL_GROUP)[group]
    starts = (keys >> np.uint64(30)).astype(np.int64)
    one, two = [], []
    for step in range(1, SMALL_GROUP):
        near = np.flatnonzero((keys[:-step] == keys[step:]) & small[:-step]) if len(keys) > step else np.zeros(0, int)
        if not len(near):
            break
        hit = near[linked(fps[near], fps[near + step], starts[near])]
        one.append(fps[hit])
        two.append(fps[hit + step])
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        for a, b in _forest(fps[first[g] : first[g] + sizes[g]], int(starts[first[g]])):
            one.append(a)
            two.append(b)
    if not one:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(one), np.concatenate(two)


def links(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect all within MOST_BITS of each other."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 1 << 14):
                part = fps[at : at + (1 << 14)]
                keys = ring_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64).copy())
            fps.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64).copy())
        if keys:
            a, b = group_links(np.concatenate(keys), np.concatenate(fps))
            pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["a", "b"])

    parts = max(n_partitions(distinct), -(-distinct.count() * sum(WIDTHS) // ROWS_A_TASK))
    return distinct.select("fp").mapInArrow(emit, "key long, fp long").repartition(parts, "key").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row for each document: the carried columns, fingerprint, component_id and component, one of its fingerprints.

    Defined cases: a null text is an empty one, whose fingerprint is zero; rows with one doc_id are one
    document's; a row without doc_id links others but never names a component (one of such rows only is
    named null); an empty table gives no rows; other columns are ignored. Equal fingerprints are collapsed before
    any comparison, so copies cost one row, and all links between different fingerprints are kept.
    """
    made = durable(fingerprints(docs, carry, text))
    named = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = durable(named)
    roots = components(links(distinct))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(names, "root").select("fp", "root", "component_id")
    joined = made.join(by_fp, "fp", "left")
    return joined.select(*carry, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce("root", "fp").alias("component"))
