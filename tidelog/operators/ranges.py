"""Orders over all rows of a key, without one task for a key: ranges of values, each sorted apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of a key's values.
RANGES = 64


def _same(keys: tuple[str, ...], prefix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(prefix + k))
    return out


def _joined(rows: DataFrame, facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows with the facts of their key; facts: a row for each key."""
    other = facts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in facts.columns if c not in keys])
    return rows.join(other, _same(keys, "__k_")).drop(*[f"__k_{k}" for k in keys])


def ranged(rows: DataFrame, value: str, keys: tuple[str, ...], ranges: int = RANGES) -> DataFrame:
    """rows with __range: equal values share one, greater ones have the same or a greater; about equally many rows each.

    The bounds are approximate quantiles, which change the sizes of ranges and
    no result.
    """
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, shares, 1000)).alias("__bounds"))
    return _joined(rows, bounds, keys).withColumn("__range", F.size(F.filter("__bounds", lambda b: b < F.col(value)))).drop("__bounds")


def before(rows: DataFrame, keys: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """rows of ranged() with each of `sums` over all earlier ranges of their key, and over the whole key as <name>_all."""
    cells = rows.groupBy(*keys, "__range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])  # RANGES rows a key at most
    order, whole = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
    cells = cells.select(*keys, "__range", *[F.coalesce(F.sum(n).over(order), F.lit(0)).alias(n) for n in sums], *[F.sum(n).over(whole).alias(f"{n}_all") for n in sums])
    return _joined(rows, cells, (*keys, "__range"))
