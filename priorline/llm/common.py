"""What several corpus operators share: reading, durable cuts of lineage, text as one byte buffer."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text that one vectorised step works on.
STEP_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(column: str | Column) -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared checkpoint folder; lost executors cost nothing then.

    A folder of our own is taken only where the session names none and runs on one machine, as in tests.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """As durable(), and the shuffles that led to it leave the disk now, not when the driver happens to collect its garbage.

    Frames that the caller still holds keep theirs.
    """
    out = durable(df)
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def without(docs: DataFrame, names: list[str]) -> DataFrame:
    """Docs without the columns of these names in any case, which is how Spark tells names apart."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])


def packed(docs: DataFrame) -> Column:
    """All columns as one, _row, so that no name of theirs can clash with an operator's own; "_row.*" brings them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, body) are in verdicts; body is xxhash64 of the text, so that rows with one doc_id part."""
    wanted = verdicts.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body")).distinct()
    rows = docs.select(packed(docs), F.col("doc_id").alias("_doc"), F.xxhash64(whole("text")).alias("_hash"))
    return rows.join(wanted.hint("shuffle_hash"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_body")), "left_semi").select("_row.*")


def with_body(docs: DataFrame) -> DataFrame:
    """Docs with the column that keep() knows a text by."""
    return docs.withColumn("body", F.xxhash64(whole("text")))


def n_partitions(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@dataclass
class Texts:
    """Some rows' texts in one buffer: row i holds bytes start[i]:stop[i] of data."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    rows: slice

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.stop[i]].tobytes()


def text_steps(batch: pa.RecordBatch, column: str = "text", step: int = STEP_BYTES) -> Iterator[Texts]:
    """The batch's texts in steps of about so many bytes; one long text makes a step of its own."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + step, "right")) - 1)
        yield Texts(raw[at[first] : at[last]], at[first:last] - at[first], at[first + 1 : last + 1] - at[first], slice(first, last))
        first = last


def row_of(texts: Texts) -> np.ndarray:
    """For each byte of the buffer, the row it belongs to."""
    return np.repeat(np.arange(len(texts.start)), texts.stop - texts.start)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def word_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of each word in the buffer; words never cross rows."""
    n = len(texts.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_IS_SPACE[texts.data]
    begins = np.zeros(n + 1, bool)
    begins[texts.start] = True
    begins[texts.stop] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | begins[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | begins[1:n]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(texts.stop, start, "right")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * (out[have - 1 : have] * base)
        have += more
    return out[:n]


@dataclass
class PrefixHash:
    """Prefix sums of a polynomial over 64-bit symbols: the hash of any run in a constant number of steps."""

    sums: np.ndarray
    undo: np.ndarray

    @classmethod
    def over(cls, symbols: np.ndarray) -> PrefixHash:
        n = len(symbols)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols.astype(np.uint64) * powers(n), out=sums[1:])
        return cls(sums, powers(n + 1, _UNBASE))

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.undo[start]
