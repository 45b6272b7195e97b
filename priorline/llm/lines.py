"""Line dedup by a deletion-neighbourhood join, in DataFrame functions throughout.

A line is its words. Two lines are near if one word changed, added or dropped makes one the other. Every
line emits its deletion variants as hashed keys: lines that differ in one word share the variant without that
word (and its place and their length); a line with one word more has a variant that is the other line.
A line's hash is the exclusive or over its words' hashes with their places, so all its variants cost one pass along it.
Keys meet by their earliest line only, so no group is expanded into pairs. Before that, lines are kept
that share their first or their last half with another line, as near lines must.

The corpus's words are split and hashed once, into a narrow table of lines; only the texts of lines kept are read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import durable, whole

#: Shorter lines are only compared for equality: with one word changed any two would be near.
LEAST_WORDS = 5
#: Candidate lines (of seven numbers each) up to this many are sent to the tasks that read the texts, 16 MB at most;
#: beyond, texts and candidates are dealt by document.
MOST_SENT_ROWS = 100_000
#: Words of a line that are summed up in one go.
CHUNK = 64
_LAST = (1 << 63) - 1
KEYS = ("k0", "k1", "k2", "k3")


def _normal(line: Column) -> Column:
    """The line's words with one space between any two; most lines are so already and cost a search only."""
    for space in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(space), F.lit(" "))
    return F.trim(F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, " +", " ")).otherwise(line))


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " ", -1), "")


def raw_lines(docs: DataFrame) -> DataFrame:
    """rank, body, line_no and line for all lines."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("rank"), whole("text").alias("text"))
    return rows.select("rank", F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def read_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """rank, body, line_no, n words, h1, h2 and k0 to k3 (null under least_words) for each line; a blank one has no words."""
    lines = raw_lines(docs).withColumn("line", _normal(F.col("line")))
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    counted = lines.withColumn("n", F.when(F.octet_length("line") == 0, 0).otherwise(spaces + 1))
    halves = [F.when(F.col("n") >= least_words, k).alias(f"k{i}") for i, k in enumerate(half_keys(F.col("line"), F.col("n")))]
    return counted.select("rank", "body", "line_no", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line"), F.col("n")).alias("h2"), *halves)


def half_sizes(n: Column) -> list[tuple[str, Column]]:
    """The side and size of each half that a near line of equal length, or one word shorter, shares."""
    return [(side, F.floor(m / 2).cast("int")) for m in (n, n - 1) for side in ("first", "last")]


def half_keys(line: Column, n: Column) -> list[Column]:
    """The halves' hashes in the order of half_sizes; with an odd number of words both sizes are the same and count once."""
    sizes = half_sizes(n)
    keys = [F.xxhash64(F.lit(side), size, F.call_function("substring_index", line, F.lit(" "), size if side == "first" else -size)) for side, size in sizes]
    return keys[:2] + [F.when(n % 2 == 0, k) for k in keys[2:]]


def _bounds(n: Column, at: Column) -> tuple[Column, Column]:
    """The places between which the differing word stands if the half at this place of half_sizes is shared."""
    sizes = half_sizes(n)
    size = F.when(at < 2, sizes[0][1]).otherwise(sizes[2][1])
    return F.when(at % 2 == 0, size + 1).otherwise(F.lit(1)), F.when(at % 2 == 0, n).otherwise(n - size)


def _edit_within_one(a: Column, b: Column) -> Column:
    """Whether two word lists are at most one word apart: their common ends cover all but that word."""
    least = F.least(F.size(a), F.size(b))

    def common(x: Column, y: Column) -> Column:
        same = F.zip_with(F.slice(x, F.lit(1), least), F.slice(y, F.lit(1), least), lambda p, q: p == q)
        at = F.array_position(same, F.lit(False))
        return F.when(at > 0, at - 1).otherwise(F.size(same))

    ends = common(a, b) + common(F.reverse(a), F.reverse(b))
    return F.when(F.size(a) == F.size(b), ends >= F.size(a) - 1).when(F.abs(F.size(a) - F.size(b)) == 1, ends >= least).otherwise(False)


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used, in lambdas too."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column) -> Column:
    """What is before each value: the exclusive or of all values to its left, within chunks first and then over them."""

    def along(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(v))))

    def spread(s: Column) -> Column:
        return F.flatten(F.zip_with(s["chunks"], s["before"], lambda c, b: F.when(c.isNull(), F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda v: v.bitwiseXOR(b)))))

    def chunked(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(v), F.lit(CHUNK)), lambda at: along(F.slice(v, at, F.lit(CHUNK))))

    def offsets(c: Column) -> Column:
        return F.struct(c.alias("chunks"), along(F.transform(c, lambda x: F.element_at(x, -1))).alias("before"))

    return _with(_with(_with(values, chunked), offsets), spread)


def variants(words: Column, low: Column, high: Column) -> Column:
    """(kind, key) for words low to high: 0 the word's place left blank, 1 the word dropped; and 2, the line itself.

    A line's hash is that of its length and the words' hashes with their places; behind a dropped word all places are one less.
    """
    n = F.size(words)

    def sums(s: Column) -> Column:
        before = _running(F.zip_with(s["own"], s["moved"], lambda a, b: a.bitwiseXOR(b)))
        each = F.arrays_zip(s["own"].alias("own"), s["moved"].alias("moved"), F.slice(before, F.lit(1), F.size(s["own"])).alias("before"))
        return F.struct(F.slice(each, low, high - low + 1).alias("each"), _xor(s["own"]).alias("all_own"), _xor(s["moved"]).alias("all_moved"), n.alias("n"), low.alias("low"))

    def keys(s: Column) -> Column:
        def two(x: Column, k: Column) -> Column:
            blank = F.xxhash64(F.lit(0), s["low"] + k, s["n"], s["all_own"].bitwiseXOR(x["own"]))
            dropped = F.xxhash64(F.lit(1), s["n"] - 1, s["all_moved"].bitwiseXOR(x["moved"]).bitwiseXOR(x["before"]))
            return F.array(F.struct(F.lit(0).alias("kind"), blank.alias("key")), F.struct(F.lit(1).alias("kind"), dropped.alias("key")))

        full = F.array(F.struct(F.lit(2).alias("kind"), F.xxhash64(F.lit(1), s["n"], s["all_own"]).alias("key")))
        return F.concat(F.flatten(F.transform(s["each"], two)), full)

    placed = F.struct(F.transform(words, lambda w, i: F.xxhash64(w, i + 1)).alias("own"), F.transform(words, lambda w, i: F.xxhash64(w, i)).alias("moved"))
    return _with(_with(placed, sums), keys)


def _sized(small: DataFrame, rows: int) -> DataFrame:
    """The smaller side of a join: sent to all tasks if its rows, which were counted, are few; else dealt out with the other."""
    return F.broadcast(small) if rows <= MOST_SENT_ROWS else small.hint("shuffle_hash")


def candidates(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """rank, line_no, h1, h2, words, low, high: one row for each line text that shares a half with another line text."""
    halves = distinct.filter("k0 is not null").select("p", "h1", "h2", "n", F.posexplode(F.array(*KEYS)).alias("at", "key")).filter("key is not null")
    met = halves.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).filter("least <> most").select("key")
    low, high = _bounds(F.col("n"), F.col("at"))
    alive = halves.join(met, "key").groupBy("p", "h1", "h2").agg(F.min(low).alias("low"), F.max(high).alias("high"))
    alive = durable(alive.select("p.rank", "p.body", "p.line_no", "h1", "h2", "low", "high"))
    lines = raw_lines(docs).join(_sized(alive, alive.count()), ["rank", "body", "line_no"])
    # Rows with one doc_id and one text hold the same line at the same place.
    first = lines.groupBy("h1", "h2").agg(F.first(F.struct("rank", "body", "line_no", "line", "low", "high")).alias("f"))
    return durable(first.select("f.rank", "f.body", "f.line_no", "h1", "h2", _words(F.col("f.line")).alias("words"), "f.low", "f.high"))


def earliest(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2, from_rank, from_line): for each line text with an equal or near line, where the first of those stands."""
    at = F.struct("rank", "line_no", "body")
    distinct = durable(lines.groupBy("h1", "h2").agg(F.min(at).alias("p"), F.count(F.lit(1)).alias("count"), *[F.first(c).alias(c) for c in ("n", *KEYS)]))
    equal = distinct.filter(F.col("count") > 1).select("h1", "h2", "p")
    held = candidates(docs, distinct)
    shared = held.select("h1", at.alias("p"), F.explode(variants(F.col("words"), F.col("low"), F.col("high"))).alias("v")).select("h1", "p", "v.kind", "v.key")
    met = shared.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("key")
    few = durable(shared.join(met, "key"))
    least = [F.min(F.when(F.col("kind") == k, F.col("p"))).alias(n) for k, n in ((0, "blank"), (1, "dropped"), (2, "full"))]
    first = few.groupBy("key").agg(*least)
    other = F.when(F.col("kind") == 0, F.col("blank")).when(F.col("kind") == 1, F.col("full")).otherwise(F.col("dropped"))
    near = few.join(first, "key").withColumn("other", other).filter("other < p").select("p", "other").distinct()
    theirs = held.select(at.alias("other"), F.col("words").alias("theirs"))
    mine = held.select(at.alias("p"), "h1", "h2", F.col("words").alias("mine"))
    proven = near.join(theirs, "other").join(mine, "p").filter(_edit_within_one(F.col("mine"), F.col("theirs")))
    found = equal.unionByName(proven.select("h1", "h2", F.col("other").alias("p")))
    return found.groupBy("h1", "h2").agg(F.min("p").alias("p")).select("h1", "h2", F.col("p.rank").alias("from_rank"), F.col("p.line_no").alias("from_line"))


def line_drops(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_dropped and dropped, the dropped lines' numbers from 0.

    A line goes if an equal or near line stands earlier, by doc_id and then by line; blank lines stay. What
    stands earlier is judged on the input. Lines under least_words are near to equal ones only. Defined cases: a null text is one blank line; rows without doc_id come
    last; rows with one doc_id stand at one place, so neither drops the other's lines; an empty table gives
    no rows; other columns are ignored. Keys are 128-bit for equal lines; near lines are verified word by word.
    """
    # Blank lines are left out of the table and not of the scan, which would normalise each line for the filter once more.
    lines = durable(read_lines(docs, least_words)).filter("n > 0")
    gone = lines.select("rank", "body", "line_no", "h1", "h2").join(earliest(docs, lines), ["h1", "h2"]).filter((F.col("rank") > F.col("from_rank")) | ((F.col("rank") == F.col("from_rank")) & (F.col("line_no") > F.col("from_line"))))
    drops = gone.select("rank", "body", "line_no").distinct().groupBy("rank", "body").agg(F.sort_array(F.collect_list("line_no")).alias("dropped"))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("rank"), F.xxhash64(whole("text")).alias("body"), (F.length(whole("text")) - F.length(F.replace(whole("text"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    joined = base.join(drops, ["rank", "body"], "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def kept_texts(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """Docs with the dropped lines taken out of text; drops is line_drops() of the same rows, whose doc_id must be unique."""
    numbers = F.split("dropped", ",")
    lines = F.split(whole("text"), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(numbers, i.cast("string")))
    joined = docs.join(drops.select(F.col("doc_id").alias("_id"), "dropped"), F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.withColumn("text", F.array_join(kept, "\n")).select(*docs.columns)
