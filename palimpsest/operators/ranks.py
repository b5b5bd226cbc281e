"""Ranks, running sums and medians of ordered rows without gathering a key's rows in one task.

Rows are dealt by ranges of (keys, order), so a key that holds most rows lies in many partitions. The rows
are written with their place in the partition; counts by partition and key, which are few, give what comes before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

_AT, _PIECE, _FIRST, _N, _BEFORE = "at_", "piece_", "first_", "n_", "before_"


def _dealt(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with _AT, which ascends in the order of all, and _PIECE, the number of the partition."""
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return written(ranged.withColumn(_AT, F.monotonically_increasing_id())).withColumn(_PIECE, F.shiftright(_AT, 33))


def _same(keys: list[str]) -> Column:
    on = F.col(_PIECE) == F.col(f"s_{_PIECE}")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"s_{k}"))
    return on


def _pieces(dealt: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """A row for each key and partition: where its rows begin, and the sum of what comes before it in the partitions before."""
    sums = dealt.groupBy(*keys, _PIECE).agg(F.min(_AT).alias(_FIRST), F.sum(amount).alias(_N))
    earlier = Window.partitionBy(*keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    out = sums.withColumn(_BEFORE, F.coalesce(F.sum(_N).over(earlier), F.lit(0)))
    return out.select(*(F.col(c).alias(f"s_{c}") for c in [*keys, _PIECE]), _FIRST, _BEFORE)


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their rank from 0 among those of equal keys (all rows without keys)."""
    dealt = _dealt(rows, keys, order)
    rank = F.col(_BEFORE) + F.col(_AT) - F.col(_FIRST)
    return dealt.join(_pieces(dealt, keys, F.lit(1)), _same(keys)).select(*rows.columns, rank.cast("long").alias(name))


def sums_before(rows: DataFrame, keys: list[str], order: list[Column], amount: Column, name: str) -> DataFrame:
    """rows with the sum of amount over those before them of equal keys; each window is one key's rows in one partition."""
    dealt = _dealt(rows, keys, order)
    here = Window.partitionBy(*keys, _PIECE).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn(_N, F.coalesce(F.sum(amount).over(here), F.lit(0)))
    return own.join(_pieces(dealt, keys, amount), _same(keys)).select(*rows.columns, (F.col(_BEFORE) + F.col(_N)).cast("long").alias(name))


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks) -> DataFrame:
    """The rows (keys, value) at the ranks that ranks(n) gives for n values of a key; nulls don't count."""
    some = rows.where(F.col(value).isNotNull()).select(*keys, value)
    counts = some.groupBy(*(F.col(k).alias(f"c_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("values_"))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"c_{k}"))
    placed = ranked(some, keys, [F.col(value)], "rank_").join(counts, on)
    return placed.where(F.array_contains(ranks(F.col("values_")), F.col("rank_"))).select(*keys, value)


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name): the exact median of value by keys, of an even number the mean of the middle two."""
    middle = at_ranks(rows, keys, value, lambda n: F.array(F.floor((n - 1) / 2), F.floor(n / 2)))
    return middle.groupBy(*keys).agg(F.avg(value).alias(name))
