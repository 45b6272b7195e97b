"""Personal data, by fixed forms and by bootstrapped contextual extraction.

The fixed forms' matches are the seeds. Words before a seed are lexical patterns of its kind; patterns and the
identifier-like tokens they introduce form a graph. Spark scores patterns by the seeds among their
instances, lets the high-confidence ones name unseen instances, takes those as seeds, and goes round again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import durable, whole

KINDS = ("email", "ip", "card", "phone")
#: A pattern is trusted with so many different seeds, such a share of one kind among them, and such a share of seeds
#: among all identifier-like tokens that it introduces.
LEAST_SEEDS = 3
LEAST_PURITY = 0.8
LEAST_SCORE = 0.5
#: The rounds end when no pattern names an unseen instance; each round names some, and more rounds than these are an error.
MOST_ROUNDS = 100
#: A token that may be an identifier has so many digits.
LEAST_DIGITS = 5
#: Code points before an instance that are searched for its two words at first; more if they hold no two.
REACH = 96

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9(][0-9()./-]*(?:\x20[0-9()./-]*[0-9][0-9()./-]*)+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]+")
_AT = re.compile(r"[(\[{]at[)\]}]", re.IGNORECASE)
_DIGIT = re.compile(r"[0-9]")
_LETTERS = bytes(range(48, 58)) + b"@"
_HIDDEN = tuple(a + b + c for a, c in ((b"(", b")"), (b"[", b"]"), (b"{", b"}")) for b in (b"at", b"At", b"aT", b"AT"))


def luhn(digits: str) -> bool:
    total = 0
    for at, x in enumerate(reversed(digits)):
        n = int(x) * (1 + at % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with a local part, which starts after the last match at the earliest, and a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        hit = _DOMAIN.match(text, at + 1) if start < at else None
        if hit:
            yield start, hit.end()
            done = hit.end()
        else:
            # Nothing before this @ can belong to a later one.
            done = at + 1
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, stop, kind's place) of the fixed forms, in order."""
    found = [(a, b, 0) for a, b in emails(text)]
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(found)


def patterns_before(text: str, start: int) -> list[str]:
    """Lexical patterns of an instance: the word before it, if it ends as a label does, and the two words before it."""
    reach = REACH
    words = text[max(0, start - reach) : start].split()
    while len(words) < 3 and reach < start:
        reach *= 4
        words = text[max(0, start - reach) : start].split()
    if not words:
        return []
    last = re.sub(r"[0-9]", "9", words[-1].lower())
    out = ["1 " + last] if last[-1] in ":=#" else []
    if len(words) > 1:
        out.append("2 " + re.sub(r"[0-9]", "9", words[-2].lower()) + " " + last)
    return out


def _value(token: str) -> int:
    return xxhash.xxh64_intdigest(token.casefold().encode()) - (1 << 63)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and candidates with their patterns; a candidate is a token with digits, a run of groups of digits or a
    token with a spelt-out @, that no base span touches."""
    found = [{"start": a, "stop": b, "kind": KINDS[k], "value": _value(text[a:b]), "patterns": patterns_before(text, a)} for a, b, k in base]
    at, spans = 0, [(a, b) for a, b, _ in base]
    for m in _TOKEN.finditer(text):
        hidden = _AT.search(m[0]) is not None
        if len(_DIGIT.findall(m[0])) < LEAST_DIGITS and not hidden:
            continue
        a, b = m.span()
        core = re.search(r"[:=]([^:=]*)\Z", m[0])
        if core and (len(_DIGIT.findall(core[1])) >= LEAST_DIGITS or _AT.search(core[1])):
            a = m.start() + core.start(1)
        while b > a and text[b - 1] in ".,;:!?)\"'":
            b -= 1
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        if any(x < b and y > a for x, y in spans[at : at + 8]):
            continue
        found.append({"start": a, "stop": b, "kind": None, "value": _value(text[a:b]), "patterns": patterns_before(text, a)})
    return found


MENTION = "array<struct<start:int,stop:int,kind:string,value:bigint,patterns:array<string>>>"


def read_mentions(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The carried columns and, for each row, base (start, stop, kind_at) and all mentions."""
    kinds = dict(docs.dtypes)
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind_at", pa.int32()), ("kind", pa.string())]))
    mention_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("value", pa.int64()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, found = [], []
            for x in batch.column(batch.num_columns - 1).cast(pa.binary()):
                body = x.as_py()
                if len(body.translate(None, _LETTERS)) == len(body) and not any(x in body for x in _HIDDEN):
                    bases.append([])
                    found.append([])
                    continue
                text = body.decode()
                own = base_spans(text)
                bases.append([{"start": a, "stop": b, "kind_at": k, "kind": KINDS[k]} for a, b, k in own])
                found.append(mentions(text, own))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bases, base_type), pa.array(found, mention_type)], [*carry, "base", "mentions"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "base array<struct<start:int,stop:int,kind_at:int,kind:string>>", f"mentions {MENTION}"])
    return docs.select(*carry, whole(text).alias("_text")).mapInArrow(run, schema)


def bootstrap(edges: DataFrame, rounds: int = MOST_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, value, kind or null, n) to (values: value, kind, score) and (patterns: pattern, kind, score).

    A pattern's kind is the most frequent one among its seeds; its score is the share of its instances that are
    seeds of that kind. An instance's score is one less the product of what its trusted patterns leave.
    """
    known = durable(edges.filter("kind is not null").groupBy("value").agg(F.max("kind").alias("kind"), F.lit(1.0).alias("score"), F.lit(True).alias("given")))
    trusted = None
    for _ in range(rounds):
        held = edges.select("pattern", "value").distinct().join(known, "value", "left")
        by_kind = held.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("weight"))
        whole_of = by_kind.groupBy("pattern").agg(
            F.sum("n").alias("n_all"), F.sum(F.when(F.col("kind").isNotNull(), F.col("n")).otherwise(0)).alias("n_seeds"),
            F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind", "weight"))).alias("best"),
        )
        trusted = durable(
            whole_of.filter((F.col("n_seeds") >= LEAST_SEEDS) & (F.col("best.n") >= LEAST_PURITY * F.col("n_seeds")))
            .select("pattern", F.col("best.kind").alias("kind"), (F.col("best.weight") / F.col("n_all")).alias("score"))
            .filter(F.col("score") >= LEAST_SCORE)
        )
        fresh = edges.select("pattern", "value").distinct().join(trusted, "pattern").join(known.select("value"), "value", "left_anti")
        scored = fresh.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("score"))
        best = scored.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"), F.lit(False).alias("given"))
        more = durable(best.filter(F.col("score") >= LEAST_SCORE))
        if more.isEmpty():
            return known, trusted
        known = durable(known.unionByName(more))
    raise RuntimeError(f"patterns and instances did not settle in {rounds} rounds")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _is(kind: str):
    return lambda span: span["kind"] == kind


def find_personal(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each document: the carried columns, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Discovered spans have the kinds ctx_email, ctx_ip, ctx_card and ctx_phone. Defined cases: a null text is empty;
    a null or repeated doc_id is kept as it is, rows with equal doc_id and text being alike; other columns are
    ignored; an empty table gives no rows. Values meet as hashes only, and a value that stands in a
    third of all documents is one row of the graph.
    """
    body = docs.withColumn("_body", F.xxhash64(whole("text")))
    rows = durable(read_mentions(body, (*carry, "_body")))
    found = rows.select(F.explode("mentions").alias("m")).select("m.kind", "m.value", F.explode("m.patterns").alias("pattern"))
    edges = durable(found.groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n")))
    known, _ = bootstrap(edges)
    new = known.filter(~F.col("given")).select("value", F.col("kind").alias("named"))
    hits = rows.select(*carry, "_body", F.explode("mentions").alias("m")).filter("m.kind is null").select(*carry, "_body", "m.start", "m.stop", "m.value").distinct()
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("named")).cast("int") + 3
    span = F.struct("start", "stop", order.alias("kind_at"), F.concat(F.lit("ctx_"), F.col("named")).alias("kind"))
    more = hits.join(new, "value").groupBy(*carry, "_body").agg(F.collect_list(span).alias("more"))
    more = more.select(*[F.col(c).alias(f"_{c}_") for c in carry], F.col("_body").alias("_body_"), "more")
    same = F.col("_body") == F.col("_body_")
    for c in carry:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}_"))
    joined = rows.join(more, same, "left")
    by_start = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,stop:int,kind_at:int,kind:string>>"))), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["kind_at"] < b["kind_at"], -1).when(a["kind_at"] > b["kind_at"], 1).otherwise(0))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return joined.select(*carry, *counts, F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(by_start).alias("spans"))
