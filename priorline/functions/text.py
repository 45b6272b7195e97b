"""Column functions for text at the boundary."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed words that stand for a missing entry in source lists.
SENTINELS = ("None", "Missing Data", "null", "")
TRUE_WORDS, FALSE_WORDS = ("1", "true", "yes"), ("0", "false", "no")


def cleaned(x: Column) -> Column:
    """Trimmed, with the empty text as null."""
    return F.nullif(F.trim(x), F.lit(""))


def identity_text(x: Column) -> Column:
    """Case and runs of white space folded, for ASCII text; folded_text() does all of Unicode."""
    return F.lower(F.regexp_replace(F.trim(x), "\\s+", " "))


@F.pandas_udf(StringType())
def folded_text(x: pd.Series) -> pd.Series:
    """Compatibility form, case folding and white space, for any script; Spark has no function for the first two."""
    return x.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split()))


def identity_alias(x: Column) -> Column:
    """Letters and digits only, without case."""
    return F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}]", "")


def stable_id(prefix: str, x: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(x.cast("binary"), 256), 1, 24))


def patch(x: Column) -> Column:
    """A release number without the leading v, letters behind and leading zeros; seasonal ones keep their middle."""
    seasonal = x.rlike("^v?\\d+\\.S\\d+\\.\\d+")

    def number(pattern: str) -> Column:
        return F.regexp_extract(x, pattern, 1).cast("int").cast("string")

    plain = F.concat_ws(".", number("^v?(\\d+)\\."), number("^v?\\d+\\.(\\d+)"))
    return F.when(seasonal, F.concat_ws(".", number("^v?(\\d+)"), F.regexp_extract(x, "\\.(S\\d+)\\.", 1), number("\\.S\\d+\\.(\\d+)"))).when(x.rlike("^v?\\d+\\.\\d+[a-z]?$"), plain)


def timestamp(x: Column, forms: Sequence[str]) -> Column:
    """The first of some formats that fits; null if none does. Times without a zone are UTC."""
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in forms])


def tri_state(x: Column) -> Column:
    """True, false, or null for anything else."""
    word = F.lower(F.trim(x))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def without_sentinels(x: Column) -> Column:
    return F.filter(x, lambda s: s.isNotNull() & ~F.trim(s).isin(*SENTINELS))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def clip_probability(p: Column, edge: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))


def sigmoid(x: Column) -> Column:
    """The logistic function, without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def redacted(x: Column, most: int = 4000) -> Column:
    """Credentials replaced, and so many characters kept."""
    return F.substring(F.regexp_replace(x, "(password|token)\\s*=\\s*\\S+", "$1=<redacted>"), 1, most)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
