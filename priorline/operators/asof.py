"""The point-in-time kernel: what was known of a key strictly before a time.

Rows of one time form a group that sees nothing of itself. Facts are first reduced to one row per key and
time, with partial aggregation before the shuffle, so a hot key costs its number of times, not of rows; a running
window over that small table then carries the past, and rows join it by key and time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def past(keys: Sequence[str], ts: str = "ts"):
    """The frame of all strictly earlier rows, over a table with one row per key and time."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)


def prior_table(facts: DataFrame, keys: Sequence[str], sums: dict[str, Column | str], ts: str = "ts", last: dict[str, Column] | None = None, order: Column | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """One row per key and time with running state of everything earlier.

    `sums` maps names to columns or SQL expressions to be summed (0 where nothing is earlier), `maxima` to columns whose largest
    value is wanted (null where nothing is earlier), `last` to columns whose latest non-null value is wanted; `order`
    breaks ties within one time.
    """
    last, maxima = last or {}, maxima or {}
    ranked = F.struct(order if order is not None else F.lit(0))
    parts = [F.sum(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in sums.items()] + [F.max(c).alias(n) for n, c in maxima.items()]
    parts += [F.max_by(c, F.when(c.isNotNull(), ranked)).alias(n) for n, c in last.items()]
    grouped = facts.groupBy(*keys, ts).agg(*parts)
    frame = past(keys, ts)
    state = [F.coalesce(F.sum(n).over(frame), F.lit(0)).alias(n) for n in sums]
    state += [F.max(n).over(frame).alias(n) for n in maxima]
    state += [F.last(n, ignorenulls=True).over(frame).alias(n) for n in last]
    return grouped.select(*keys, ts, *state)


def as_of(probes: DataFrame, facts: DataFrame, keys: Sequence[str], sums: dict[str, Column | str], ts: str = "ts", **more) -> DataFrame:
    """Probes (with keys and ts) joined to the state of facts strictly before their time.

    Probes may hold keys and times that no fact has: they enter the table of times with empty facts first. Rows with a null
    key or time join nothing and read the empty state.
    """
    wanted = probes.select(*keys, ts).distinct()
    zero = [F.lit(None).cast(t).alias(c) for c, t in facts.dtypes if c not in (*keys, ts)]
    both = facts.unionByName(wanted.select(*keys, ts, *zero))
    state = prior_table(both, keys, sums, ts, **more)
    joined = probes.join(state, [*keys, ts], "left")
    return joined.fillna(0, subset=list(sums))


def with_prior(facts: DataFrame, keys: Sequence[str], sums: dict[str, Column | str], ts: str = "ts", **more) -> DataFrame:
    """Facts joined to their own keys' earlier state; every probe is a fact, so no union is needed."""
    return facts.join(prior_table(facts, keys, sums, ts, **more), [*keys, ts]) if keys else facts.join(prior_table(facts, keys, sums, ts, **more), ts)


def smoothed(wins: Column, games: Column, prior: Column | float, strength: float) -> Column:
    """(wins + prior * strength) / (games + strength)."""
    prior = F.lit(prior) if isinstance(prior, float) else prior
    return (wins + prior * F.lit(strength)) / (games + F.lit(strength))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def decayed(rating: Column, days: Column, half_life: float, centre: float = 1500.0) -> Column:
    """A rating drawn back to its centre by half in each half-life; unchanged without days."""
    return F.lit(centre) + (rating - F.lit(centre)) * F.pow(F.lit(0.5), F.coalesce(days, F.lit(0.0)) / F.lit(half_life))
