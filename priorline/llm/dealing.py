"""Talk between blocks of documents and buckets of keys, in packed rows.

A block sends each bucket one row: its keys there, in ascending order, or what belongs to them. The bucket's
answer to it is one row again, in the same order, so keys need not travel back. All numbers of
blocks and buckets follow the corpus's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BITS = np.uint64(48)


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of a sorted array."""
    if len(bucket):
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
            yield int(bucket[a]), slice(a, b)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys - np.uint64(1)) * np.uint64(n) >> BITS).astype(np.int64) if n < 1 << 15 else ((keys - np.uint64(1)) // np.uint64((1 << 48) // n + 1)).astype(np.int64)


def bits(*flags: np.ndarray) -> bytes:
    return np.packbits(np.concatenate(flags)).tobytes()


def unbits(payload: bytes, n: int, rows: int = 2) -> np.ndarray:
    return np.unpackbits(np.frombuffer(payload, np.uint8))[: n * rows].astype(bool).reshape(rows, n)


def answers_of(replies: pa.Table, step: int) -> dict[int, bytes]:
    return {k: p for s, k, p in zip(replies.column("step").to_pylist(), replies.column("bucket").to_pylist(), replies.column("payload").to_pylist(), strict=True) if s == step}


PACKED = "bucket long, block long, step int, payload binary"


def packed_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "block", "step", "payload"])


def block_number(table: pa.Table) -> int:
    return table.column("block")[0].as_py()


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and the gaps."""
    gaps = np.diff(keys)
    small = gaps.astype("<u4") if not len(gaps) or gaps.max() < 1 << 32 else gaps
    return bytes([small.itemsize]) + keys[:1].tobytes() + small.tobytes()


def unpacked(payload: bytes) -> np.ndarray:
    gaps = np.frombuffer(payload[9:], "<u4" if payload[0] == 4 else "<u8").astype(np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(payload[1:9], np.uint64), gaps)), dtype=np.uint64)


def hashed(keys: np.ndarray, other: np.ndarray, ids: np.ndarray) -> bytes:
    """Ascending keys, a further hash of each, and ids as the least one and what lies above it."""
    least = ids.min()
    above = ids.view(np.uint64) - np.uint64(int(least) & 0xFFFFFFFFFFFFFFFF)
    small = above.astype("<u4") if above.max() < 1 << 32 else above
    return bytes([small.itemsize]) + np.int32(len(keys)).tobytes() + least.tobytes() + small.tobytes() + other.tobytes() + packed(keys)


def unhashed(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, end = int(np.frombuffer(payload[1:5], np.int32)[0]), 13
    above = np.frombuffer(payload, "<u4" if payload[0] == 4 else "<u8", n, end).astype(np.uint64)
    end += n * payload[0]
    ids = (above + np.frombuffer(payload[5:13], np.uint64)).view(np.int64)
    return unpacked(payload[end + 8 * n :]), np.frombuffer(payload[end : end + 8 * n], np.uint64), ids


def find_shared(hot_blocks: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        parts = [unpacked(p) for p in table.column("payload").to_pylist()]
        sizes = np.array([len(p) for p in parts])
        sent = np.concatenate(parts)
        _, which, count = np.unique(sent >> np.uint64(1), return_inverse=True, return_counts=True)
        multi = count > 1
        multi[which[(sent & np.uint64(1)) > 0]] = True
        shared, hot = multi[which], (count > hot_blocks)[which]
        ends = np.cumsum(sizes)
        blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
        return packed_rows([(bucket, b, 1, bits(shared[e - n : e], hot[e - n : e])) for b, n, e in zip(blocks, sizes, ends, strict=True)])

    return run
