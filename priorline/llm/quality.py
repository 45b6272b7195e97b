"""Quality rules with n-gram perplexity.

The n-grams are runs of ORDER bytes, ASCII letters without case, so nothing bounds how many there are; every whole text is
counted. Spark adds the counts up for each language and joins the orders of a modified Kneser-Ney model, which grows
with the corpus. An n-gram's own occurrence is no evidence for it: counts are less one. The model is looked up in sorted
arrays of hashes. While it has MOST_SENT_GRAMS n-grams at most, these are sent to all tasks and the texts stay where they
are; beyond, they are dealt over buckets, blocks of documents ask each bucket for their distinct n-grams, and a bucket
answers in the order it was asked, so that no model is ever whole in one place. Both ways give the same numbers.

A document is rejected by the base rules, or because its perplexity lies below the band of its language, or above it
segment by segment even if each may follow the model of all languages together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import SPACES, mix64, text_steps, whole
from priorline.llm.common import settled as durable
from priorline.llm.dealing import PACKED, block_number, packed, packed_rows, unpacked

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Bytes of an n-gram; five fit a long and leave the sign alone.
ORDER = 5
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
#: Bytes of text that are gone over at once, at some forty times their memory.
STEP_BYTES = 1 << 19
#: N-grams, of all languages together, that are sent to all tasks: 32 MB.
MOST_SENT_GRAMS = 2_000_000
#: Bytes of the input, as Spark estimates them, that one task counts at least.
COUNTED_BYTES = 4 << 20
#: Distinct n-grams that a counting task holds before it passes them on.
MOST_HELD_GRAMS = 4_000_000
#: The band's ends in robust standard deviations below and above the language's median, and the bytes at which
#: a text's own noise doubles the variance.
BAND_BELOW = 8.0
BAND_ABOVE = 8.0
NOISE_BYTES = 400.0
#: N-grams of one segment, which the upper end takes by the better of the language's and the pooled model.
SEGMENT = 64
#: Perplexities meet in bins of so many parts of a nat for the band's median and spread.
BINS = 1000
#: Languages whose bands are sent to all tasks; more are joined by key.
MOST_SENT_BANDS = 10_000
_POOLED = "\x00"

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def grams(data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ORDER bytes in a row, and where in the buffer each starts; none crosses a text's end."""
    n = len(data) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, code = _LOWER[data], np.zeros(n, np.uint64)
    for k in range(ORDER):
        code = (code << np.uint64(8)) | low[k : k + n]
    inside = np.ones(n, bool)
    for back in range(1, ORDER):
        ends = stop - back
        inside[ends[(ends >= 0) & (ends < n)]] = False
    at = np.flatnonzero(inside)
    return code[at], at


class Asked:
    """One block's n-grams, language by language: distinct codes in ascending order within the buckets, and each text's."""

    def __init__(self, table: pa.Table, buckets: int) -> None:
        self.table = table.combine_chunks()
        names = self.table.column("_lang")
        self.languages = []
        for name in sorted(pc.unique(names).to_pylist()):
            mine = pc.equal(names, name).combine_chunks()
            rows = np.flatnonzero(mine.to_numpy(zero_copy_only=False))
            texts = self.table.column("_text").filter(mine).combine_chunks()
            codes, firsts, lasts, base = [np.zeros(0, np.uint64)], [], [], 0
            for batch in pa.table({"text": texts}).to_batches():
                for step in text_steps(batch):
                    code, at = grams(step.data, step.stop)
                    codes.append(code)
                    firsts.append(base + np.searchsorted(at, step.start))
                    lasts.append(base + np.searchsorted(at, step.stop))
                    base += len(code)
            distinct, which, count = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            bucket = (distinct % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            self.languages.append((name, rows, np.concatenate(firsts), np.concatenate(lasts), place[which], distinct[by], count[by], bucket[by]))

    def requests(self) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, slice]]:
        """(bucket, language, codes, counts, where they stand) in a fixed order."""
        for name, _, _, _, _, codes, counts, bucket in self.languages:
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield int(bucket[a]), name.encode(), codes[a:b], counts[a:b], slice(int(a), int(b))


def _tell(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows = []
        for bucket, name, codes, _, _ in Asked(table, buckets).requests():
            rows.append((bucket, block_number(table), 1, np.array([len(name)], np.int32).tobytes() + name + packed(codes)))
        return packed_rows(rows)

    return run


def _read(payload: bytes) -> tuple[bytes, bytes]:
    """The language of a request or an answer, and the rest."""
    size = int(np.frombuffer(payload, np.int32, 1)[0])
    return payload[4 : 4 + size], payload[4 + size :]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, which = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    n = np.zeros(len(codes), np.int64)
    np.add.at(n, which, np.concatenate([x for _, x in parts]))
    return codes, n


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, code, n) over every whole text, and over all languages together; a null language counts as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                codes, n = _merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for name in pc.unique(batch.column(0)).to_pylist():
                for step in text_steps(batch.filter(pc.equal(batch.column(0), name)), "text", STEP_BYTES):
                    found = np.unique(grams(step.data, step.stop)[0], return_counts=True)
                    held.setdefault(name, []).append(found)
                    size += len(found[0])
            if size > MOST_HELD_GRAMS:
                for name, parts in held.items():
                    held[name] = [_merged(parts)]
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > MOST_HELD_GRAMS // 2:
                    yield from flush()
                    size = 0
        yield from flush()

    # Small partitions are counted together: each counting task passes on its distinct n-grams, and those are much the same.
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    pairs = docs.select(whole(F.col(lang).cast("string")).alias("lang"), whole(text).alias("text")).coalesce(min(1 << 20, size // COUNTED_BYTES + 1))
    return pairs.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame) -> DataFrame:
    """(lang, code, own, pooled): each n-gram's log-probability in its language's model and in that of all languages."""
    every = counts.groupBy("code").agg(F.sum("n").alias("n")).select(F.lit(_POOLED).alias("lang"), "code", "n")
    model = kneser_ney(counts.select("lang", "code", "n").unionByName(every))
    pooled = F.max(F.when(F.col("lang") == _POOLED, F.col("log_p"))).over(Window.partitionBy("code"))
    return durable(model.select("lang", "code", F.col("log_p").alias("own"), pooled.alias("pooled")).filter(F.col("lang") != _POOLED))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, code, n) of all n-grams to (lang, code, log_p): modified Kneser-Ney, the orders joined from the shortest up.

    The highest order counts occurrences less one, lower ones the different bytes before. A context without counts
    leaves all to the next order; below the shortest all bytes are alike.
    """
    tables = [durable(counts.select("lang", "code", (F.col("n") - 1).alias("c")))]
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("code").bitwiseAND(F.lit((1 << 8 * order) - 1))
        # Each order is stored before the next one reads it, or all longer ones would be shuffled again.
        tables.append(durable(tables[-1].groupBy("lang", suffix.alias("code")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c"))))
    lower = None
    for order, table in enumerate(reversed(tables), 1):
        some = table.filter("c > 0")

        def n(k: Column | int) -> Column:
            return F.sum((F.col("c") == k).cast("long")).cast("double")

        of = some.groupBy(F.col("lang").alias("_l")).agg(*[n(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        enough = F.least("n1", "n2", "n3", "n4") > 0
        cut = [F.when(enough, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05)), F.lit(k - 0.05))).otherwise(0.5).alias(f"d{k}") for k in (1, 2, 3)]
        of = of.select("_l", *cut)
        # A context has 256 continuations at most; a window over it moves the order once, where sums and a join back would do so again.
        context = Window.partitionBy("lang", F.shiftright("code", 8))
        sums = {"total": F.sum("c")} | {f"t{k}": F.sum((F.col("c") == k if k < 3 else F.col("c") >= k).cast("long")) for k in (1, 2, 3)}
        held = table.select("*", *[x.over(context).alias(k) for k, x in sums.items()]).join(of, F.col("lang") == F.col("_l"), "left")
        if lower is None:
            below = F.lit(1 / 256)
        else:
            held = held.join(lower, (F.col("lang") == F.col("_pl")) & (F.col("code").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)) == F.col("_pc")))
            below = F.col("_p")
        own = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, 1 - F.col("d1")).when(F.col("c") == 2, 2 - F.col("d2")).otherwise(F.col("c") - F.col("d3"))
        left = F.col("d1") * F.col("t1") + F.col("d2") * F.col("t2") + F.col("d3") * F.col("t3")
        p = F.when(F.col("total") > 0, (own + left * below) / F.col("total")).otherwise(below)
        lower = held.select(F.col("lang").alias("_pl"), F.col("code").alias("_pc"), p.alias("_p"))
    return lower.select(F.col("_pl").alias("lang"), F.col("_pc").alias("code"), F.log("_p").cast("float").alias("log_p"))


class Model:
    """Log-probabilities of n-grams of some languages in sorted arrays of their hashes."""

    def __init__(self, table: pa.Table) -> None:
        names = table.column("lang")
        self.held = {}
        for name in pc.unique(names).to_pylist():
            own = table.filter(pc.equal(names, name))
            hashes = mix64(own.column("code").to_numpy().astype(np.uint64))
            order = np.argsort(hashes)
            hashes = hashes[order]
            # Where the hashes with given first bits begin: from there a hash is a step or two away.
            bits = (2 * len(hashes)).bit_length()
            shift = np.uint64(64 - bits)
            begin = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << shift).astype(np.int32)
            self.held[name] = hashes, shift, begin, np.stack([own.column(c).to_numpy()[order] for c in ("own", "pooled")])

    def logs(self, name: str, codes: np.ndarray) -> np.ndarray:
        """Two rows: in the language's model and in the pooled one."""
        if not len(codes):
            return np.zeros((2, 0), np.float32)
        hashes, shift, begin, values = self.held[name]
        wanted = mix64(codes)
        at = begin[(wanted >> shift).astype(np.int64)].astype(np.int64)
        open_ = np.flatnonzero(hashes[at] != wanted)
        while len(open_):
            at[open_] += 1
            open_ = open_[hashes[at[open_]] != wanted[open_]]
        return values[:, at]


def _answer(requests: pa.Table, table: pa.Table) -> pa.Table:
    """For each request the log-probabilities in its language's and in the pooled model."""
    rows, model = [], Model(table)
    for bucket, block, payload in zip(*(requests.column(c).to_pylist() for c in ("bucket", "block", "payload")), strict=True):
        key, codes = _read(payload)
        rows.append((bucket, block, 2, np.array([len(key)], np.int32).tobytes() + key + model.logs(key.decode(), unpacked(codes)).tobytes()))
    return packed_rows(rows)


def base_metrics(body: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = body.split()
    lines = [x for x in body.split(b"\n") if x.strip()]
    solid = body.translate(None, SPACES)
    chars = len(solid.decode("utf-8", "replace"))
    repeated = 0
    if len(words) > WINDOW:
        # Windows are numbered by doubling: equal numbers are equal windows, and no window is ever spelled out.
        known: dict[bytes, int] = {}
        number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        size = 1
        while size < WINDOW and len(known) < len(words):
            _, number = np.unique(number[:-size] * len(words) + number[size:], return_inverse=True)
            size *= 2
        if size == WINDOW:
            often = np.bincount(number)[number] > 1
            if often.any():
                step = np.zeros(len(words) + 1, np.int64)
                at = np.flatnonzero(often)
                np.add.at(step, at, 1)
                np.add.at(step, at + WINDOW, -1)
                repeated = int(np.count_nonzero(np.cumsum(step)[:-1]))
    return len(words), chars, len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def eased(own: np.ndarray, pooled: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mean surprise of each run first:last of trigrams, segment by segment the less of its language's and the pooled model's."""
    n = -(-(last - first) // SEGMENT)
    whose = np.repeat(np.arange(len(first)), n)
    begin = first[whose] + SEGMENT * (np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n))
    end = np.minimum(begin + SEGMENT, last[whose])
    least = np.minimum(own[begin] - own[end], pooled[begin] - pooled[end])
    return np.bincount(whose, least, len(first)) / np.maximum(last - first, 1)


MEASURED = ", ".join(["_lang string", *(f"{m} long" for m in METRICS), "n_grams long", "nats double", "eased double"])


def _sums(logs: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_grams, nats and eased nats of the texts that hold the n-grams first:last."""
    mine, pooled = (np.concatenate(([0.0], np.cumsum(x, dtype=np.float64))) for x in logs)
    size = last - first
    nats = -(mine[last] - mine[first]) / np.maximum(size, 1)
    return size, np.where(size > 0, nats, np.nan), np.where(size > 0, eased(mine, pooled, first, last), np.nan)


def _measured(texts: pa.ChunkedArray, names: pa.ChunkedArray, sums: np.ndarray) -> dict[str, pa.Array]:
    metrics = np.array([base_metrics(x.as_py()) for x in texts.cast(pa.large_binary())], np.int64).reshape(-1, 5)
    out = {"_lang": names} | {m: pa.array(metrics[:, i]) for i, m in enumerate(METRICS)} | {"n_grams": pa.array(sums[0].astype(np.int64))}
    return out | {"nats": pa.array(sums[1], from_pandas=True), "eased": pa.array(sums[2], from_pandas=True)}


def _score_block(buckets: int, carry: tuple[str, ...]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        asked = Asked(table, buckets)
        told = {}
        for bucket, payload in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist(), strict=True):
            key, found = _read(payload)
            told[bucket, key] = np.frombuffer(found, np.float32).reshape(2, -1)
        logs = {name: np.zeros((2, len(codes)), np.float32) for name, _, _, _, _, codes, _, _ in asked.languages}
        for bucket, key, _, _, own in asked.requests():
            logs[key.decode()][:, own] = told[bucket, key]
        sums = np.zeros((3, asked.table.num_rows))
        for name, rows, first, last, which, *_ in asked.languages:
            sums[:, rows] = _sums(logs[name][:, which], first, last)
        columns = {c: asked.table.column(f"_c{i}") for i, c in enumerate(carry)}
        return pa.table(columns | _measured(asked.table.column("_text"), asked.table.column("_lang"), sums))

    return run


def _score_batches(sent, carry: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1)
            sums = np.zeros((3, len(batch)))
            for name in pc.unique(names).to_pylist():
                mine = pc.equal(names, name)
                rows = np.flatnonzero(mine.to_numpy(zero_copy_only=False))
                for step in text_steps(batch.filter(mine), "_text", STEP_BYTES):
                    codes, at = grams(step.data, step.stop)
                    sums[:, rows[step.rows]] = _sums(sent.value.logs(name, codes), np.searchsorted(at, step.start), np.searchsorted(at, step.stop))
            columns = dict(zip(carry, batch.columns[2:], strict=True)) | _measured(batch.column(0), names, sums)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def score(docs: DataFrame, carry: tuple[str, ...], text: str = "text", lang: str = "lang") -> DataFrame:
    """The carried columns, _lang, the base metrics, n_grams, nats (mean surprise of an n-gram; null without any) and eased nats."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), MEASURED])
    held = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    body = docs.select(whole(text).alias("_text"), whole(F.col(lang).cast("string")).alias("_lang"), *held)
    model = fit(durable(count_grams(docs, text, lang)))
    if model.count() <= MOST_SENT_GRAMS:
        return body.mapInArrow(_score_batches(docs.sparkSession.sparkContext.broadcast(Model(model.toArrow())), carry), schema)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // BUCKET_BYTES)) | 1
    salt = F.xxhash64("_text", *[F.col(f"_c{i}").cast("string") for i in range(len(carry))])
    by_block = body.withColumn("block", F.pmod(salt, F.lit(blocks))).repartition(blocks, "block").groupBy("block")
    asked = by_block.applyInArrow(_tell(buckets), PACKED).groupBy("bucket")
    answers = asked.cogroup(model.withColumn("bucket", F.col("code") % F.lit(buckets)).groupBy("bucket")).applyInArrow(_answer, PACKED)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(_score_block(buckets, carry), schema)


def bands(scored: DataFrame, of: str = "nats") -> DataFrame:
    """(lang, centre, spread): the median of a column and its robust deviation, from counts of fine bins."""
    bins = scored.filter(F.col(of).isNotNull()).groupBy("_lang", F.round(F.col(of) * BINS).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    centre = bins.groupBy("_lang").agg(F.expr("percentile(bin, 0.5, n)").alias("centre"))
    apart = bins.join(centre, "_lang").withColumn("apart", F.abs(F.col("bin") - F.col("centre")))
    spread = apart.groupBy("_lang").agg(F.first("centre").alias("centre"), F.expr("percentile(apart, 0.5, n)").alias("apart"))
    return spread.select("_lang", (F.col("centre") / BINS).alias("centre"), (F.greatest(F.col("apart") * 1.4826, F.lit(5.0)) / BINS).alias("spread"))


def judge(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", lang: str = "lang") -> DataFrame:
    """The carried columns, the base metrics, base_failed, kept, nats and perplexity.

    Defined cases: a null text has no words and so fails the base rules; a null language is the empty one; a text
    without an n-gram has no perplexity and is judged by the base rules only; repeated rows are judged
    alike; an empty table gives no rows; other columns are ignored. Every text is counted for the model.
    """
    scored = durable(score(docs, carry, text, lang))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    unit = F.sqrt(1 + F.lit(NOISE_BYTES) / F.greatest("n_grams", F.lit(1)))
    low = (F.col("nats") - F.col("centre")) / (unit * F.col("spread")) < -BAND_BELOW
    high = (F.col("eased") - F.col("high_centre")) / (unit * F.col("high_spread")) > BAND_ABOVE
    odd = F.coalesce(low | high, F.lit(False))
    upper = bands(scored, "eased").select(F.col("_lang").alias("_l"), F.col("centre").alias("high_centre"), F.col("spread").alias("high_spread"))
    both = durable(bands(scored).join(upper, F.col("_lang") == F.col("_l")).drop("_l").withColumnRenamed("_lang", "_l"))
    sent = F.broadcast(both) if both.count() <= MOST_SENT_BANDS else both
    judged = scored.join(sent, F.col("_lang") == F.col("_l"), "left")
    return judged.select(*carry, *METRICS, failed.alias("base_failed"), (~failed & ~odd).alias("kept"), "nats", F.exp("nats").alias("perplexity"))
