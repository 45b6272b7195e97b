"""Benchmark decontamination: every passage of the corpus asks a block-max index of the test items.

The items' BM25 impacts lie in blocks of a few items, with each term's largest impact in a block. A passage
first takes the terms that could not reach any threshold on their own out of the search, bounds each block
that its other terms touch, scores the blocks whose bound reaches a threshold, and keeps all items
above theirs. An item's threshold is what is left of its own score without its heaviest words, as many as
a copy may lack, so no copy within the limit is missed. Kept pairs are verified word by word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import whole

K1, B = 1.2, 0.75
BLOCK = 4
SHINGLE = 5
LEAST_OVERLAP = 0.8
#: Test items in one index; more are taken in turn, each block against all rows.
ITEMS_AT_ONCE = 20_000
#: Words of passages that one vectorised search works on.
STEP_WORDS = 1 << 17
_PUNCTUATION = bytes(32 if x < 128 and not chr(x).isalnum() else x for x in range(256))


def words_of(lowered: bytes) -> list[bytes]:
    """Words of a lower-cased UTF-8 text; ASCII punctuation parts words."""
    return lowered.translate(_PUNCTUATION).split()


def lowered(text: str) -> str:
    """The text without case, by the same rules as the corpus's texts."""
    return pc.utf8_lower(pa.scalar(text)).as_py()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's last sentence (or line) is its answer; an item of one sentence has its last fifth as answer."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", lowered(text)) if words_of(p.encode())]
    if len(parts) > 1:
        return words_of(" ".join(parts[:-1]).encode()), words_of(parts[-1].encode())
    words = words_of(lowered(text).encode())
    cut = len(words) - max(1, len(words) // 5) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Runs of five words; a shorter list is one run."""
    if not words:
        return set()
    size = min(SHINGLE, len(words))
    return set(zip(*[words[i:] for i in range(size)], strict=False))


@dataclass
class Index:
    """Terms are numbered by their largest impact, smallest first; entries of term t are entry[t]:entry[t + 1]."""

    ids: list[int]
    parts: list[tuple[list[bytes], list[bytes]]]
    term: dict[bytes, int]
    top: np.ndarray
    entry: np.ndarray
    block: np.ndarray
    largest: np.ndarray
    impact: np.ndarray
    threshold: np.ndarray
    longest: int


def build_index(items: list[tuple[int, str]]) -> Index:
    """The inverted index; items without words are left out, and equal texts stay items of their own."""
    parts = [(i, question_and_answer(t or "")) for i, t in items]
    parts = [(i, qa) for i, qa in parts if qa[0] or qa[1]]
    bags = [Counter(q + a) for _, (q, a) in parts]
    lengths = np.array([sum(b.values()) for b in bags], float)
    mean = lengths.mean() if len(bags) else 1.0
    found = Counter(w for b in bags for w in b)
    idf = {w: np.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for w, n in found.items()}
    rows = [(w, i, idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[i] / mean))) for i, b in enumerate(bags) for w, n in b.items()]
    top: dict[bytes, float] = {}
    for w, _, x in rows:
        top[w] = max(top.get(w, 0.0), x)
    term = {w: k for k, w in enumerate(sorted(top, key=lambda w: (top[w], w)))}
    cells: dict[tuple[int, int], np.ndarray] = {}
    for w, i, x in rows:
        cells.setdefault((term[w], i // BLOCK), np.zeros(BLOCK))[i % BLOCK] = x
    order = sorted(cells)
    impact = np.array([cells[k] for k in order]).reshape(-1, BLOCK)
    entry = np.searchsorted(np.array([k[0] for k in order], np.int64), np.arange(len(term) + 1))
    threshold = np.full(-(-max(len(bags), 1) // BLOCK) * BLOCK, np.inf)
    for i, bag in enumerate(bags):
        weights = sorted(idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[i] / mean)) for w, n in bag.items())
        runs = max(1, int(lengths[i]) - SHINGLE + 1)
        lacking = runs - math.ceil(Fraction(str(LEAST_OVERLAP)) * runs)
        threshold[i] = max(sum(weights[: len(weights) - lacking]) - 1e-6, 1e-9)
    return Index(
        [i for i, _ in parts], [qa for _, qa in parts], term, np.array(sorted(top.values())), entry,
        np.array([k[1] for k in order], np.int64), impact.max(axis=1) if len(order) else np.zeros(0), impact, threshold,
        int(lengths.max()) if len(bags) else 1,
    )


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first:last, the index of the range and the number, range by range."""
    n = last - first
    who = np.repeat(np.arange(len(first)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def search(index: Index, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of passage and distinct term (sorted) to all (passage, item, score) at or above the item's threshold."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(passage):
        return none
    least = index.threshold.min()
    first = np.concatenate(([True], passage[1:] != passage[:-1]))
    begin = np.flatnonzero(first)
    sums = np.cumsum(index.top[term])
    group = np.cumsum(first) - 1
    upto = sums - (sums[begin] - index.top[term[begin]])[group]
    essential = upto >= least
    spare = np.zeros(len(begin))
    np.add.at(spare, group[~essential], index.top[term[~essential]])
    at = np.flatnonzero(essential)
    if not len(at):
        return none
    who, entry = _expand(index.entry[term[at]], index.entry[term[at] + 1])
    blocks = len(index.threshold) // BLOCK
    key = group[at][who] * blocks + index.block[entry]
    cells, inverse = np.unique(key, return_inverse=True)
    bound = np.bincount(inverse, index.largest[entry]) + spare[cells // blocks]
    block_least = index.threshold.reshape(-1, BLOCK).min(axis=1)
    alive = np.flatnonzero(bound >= block_least[cells % blocks])
    if not len(alive):
        return none
    held = cells[alive]
    whose, terms = _expand(begin[held // blocks], np.append(begin[1:], len(passage))[held // blocks])
    which, entry = _expand(index.entry[term[terms]], index.entry[term[terms] + 1])
    whose = whose[which]
    own = index.block[entry] == (held % blocks)[whose]
    whose, entry = whose[own], entry[own]
    scores = np.stack([np.bincount(whose, index.impact[entry, slot], len(held)) for slot in range(BLOCK)], axis=1)
    where, slot = np.nonzero(scores >= index.threshold.reshape(-1, BLOCK)[held % blocks])
    return passage[begin[held[where] // blocks]], (held[where] % blocks) * BLOCK + slot, scores[where, slot]


def verify(index: Index, item: int, passage: list[bytes]) -> tuple[float, float, float]:
    """The shares of the item's runs of five words, of its question's and of its answer's that the passage has."""
    question, answer = index.parts[item]
    have = shingles(passage) if len(passage) >= SHINGLE else set()
    flat = b" " + b" ".join(passage) + b" "

    def share(words: list[bytes]) -> float:
        runs = shingles(words)
        if not runs:
            return 1.0
        return sum((r in have) if len(r) == SHINGLE else (b" " + b" ".join(r) + b" " in flat) for r in runs) / len(runs)

    return share(question + answer), share(question), share(answer)


def leaks_in(index: Index, texts: list[bytes]) -> list[dict[int, tuple[float, float, float, float]]]:
    """For each lower-cased text the items it holds: (score, overlap, question overlap, answer overlap), the best passage's.

    Passages are twice as long as the longest item and start at every multiple of its length, so that a copy
    lies whole in one of them.
    """
    found: list[dict] = [{} for _ in texts]
    stride, held, ids = index.longest + SHINGLE, [], []
    begins, base = [], 0

    def run() -> None:
        numbers = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        known = np.flatnonzero(numbers >= 0)
        # A word stands in the passage that starts at or before it, and in the one before that.
        place = np.concatenate([np.arange(len(x)) // stride for x in ids]) if ids else known
        offset = np.repeat(np.array(begins, np.int64), [len(x) for x in ids])
        own = (offset + place)[known]
        prior = known[place[known] > 0]
        keys = np.concatenate((own * len(index.top) + numbers[known], (own[place[known] > 0] - 1) * len(index.top) + numbers[prior]))
        keys = np.unique(keys)
        passages, items, scores = search(index, keys // len(index.top), keys % len(index.top))
        for p, item, s in zip(passages.tolist(), items.tolist(), scores.tolist(), strict=True):
            at = int(np.searchsorted(begins, p, "right")) - 1
            row, words = held[at]
            start = (p - begins[at]) * stride
            overlap, q, a = verify(index, item, words[start : start + 2 * stride])
            if overlap >= LEAST_OVERLAP and (row_best := found[row].get(item, (0.0, 0.0, 0.0, 0.0))) < (s, overlap, q, a):
                del row_best
                found[row][item] = (s, overlap, q, a)

    size = 0
    get = index.term.get
    for row, text in enumerate(texts):
        words = words_of(text)
        numbers = np.array([get(w, -1) for w in words], np.int64)
        if (numbers >= 0).any():
            held.append((row, words))
            ids.append(numbers)
            begins.append(base)
            base += -(-len(words) // stride)
            size += len(words)
        if size >= STEP_WORDS:
            run()
            held, ids, begins, base, size = [], [], [], 0, 0
    if held:
        run()
    return found


def _indexes(benchmark: DataFrame, item: str, text: str) -> Iterator[Index]:
    """An index for each block of items; the blocks' bounds come from the count, so none outgrows the driver."""
    n = benchmark.count()
    blocks = max(1, -(-n // ITEMS_AT_ONCE))
    for k in range(blocks):
        own = benchmark if blocks == 1 else benchmark.filter(F.pmod(F.xxhash64(item), F.lit(blocks)) == k)
        rows = own.select(F.col(item), F.col(text)).collect()
        yield build_index(sorted((r[0] if r[0] is not None else -1, r[1] or "") for r in rows))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): a row for each test item in a document.

    A document holds an item if a passage of it has LEAST_OVERLAP of the item's runs of five words, question
    and answer together. Defined cases: null texts are empty and hold nothing; a null doc_id is carried; a
    null item_id is item -1; repeated rows give repeated rows; an empty table on either side gives no rows;
    other columns are ignored. Documents without a leak give no row.
    """
    kind = dict(docs.dtypes)[key]
    parts = []
    for index in _indexes(benchmark, "item_id", "text"):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [x.as_py() for x in pc.utf8_lower(batch.column(1)).cast(pa.binary())]
                found = leaks_in(sent.value, texts)
                rows = [(i, sent.value.ids[item], *v) for i, x in enumerate(found) for item, v in sorted(x.items())]
                taken = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, pa.array([r[1] for r in rows], pa.int64()), *[pa.array([r[j] for r in rows], pa.float64()) for j in range(2, 6)]], ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        schema = f"doc_id {kind}, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
        parts.append(docs.select(key, whole(text).alias("_text")).mapInArrow(run, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no test item; the texts pass by once for each index and are not shuffled."""
    for index in _indexes(benchmark, "item_id", "text"):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(text))
                texts = [x.as_py() for x in pc.utf8_lower(column.fill_null("")).cast(pa.binary())]
                yield batch.filter(pa.array([not x for x in leaks_in(sent.value, texts)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
