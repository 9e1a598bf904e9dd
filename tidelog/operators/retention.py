"""Retention, deletion and thinning: what goes, and what goes with it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Ages and the buckets of which one picture stays: none in the first day, then 15 minutes, 2 hours, a day.
BUCKETS = ((DAY, None), (7 * DAY, 15 * 60_000_000), (30 * DAY, 2 * HOUR), (None, DAY))


def cutoff(now: int, days: int) -> int:
    """The last hour is never purged, whatever the setting."""
    return min(now - days * DAY, now - HOUR)


def surviving(rows: DataFrame, now: int, days: int, ts: str = "ts_us") -> DataFrame:
    return rows.where(F.col(ts) >= cutoff(now, days))


def cascade(rows: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """Rows of a dependent table whose parent stays."""
    return rows.join(gone.select(on).distinct(), on, "left_anti")


def orphans(parents: DataFrame, children: DataFrame, on: str) -> DataFrame:
    """Parents without a child left."""
    return parents.join(children.select(on).distinct(), on, "left_anti")


def thinned(pictures: DataFrame, now: int, window: str = "window") -> DataFrame:
    """One picture of each age bucket and window stays: most changed lines, then the newest, then the larger id."""
    age = F.lit(now) - F.col("ts_us")
    width = F.when(age < BUCKETS[0][0], F.lit(None).cast("long"))
    for limit, size in BUCKETS[1:]:
        width = width.when(age < limit, F.lit(size)) if limit else width.otherwise(F.lit(size))
    bucket = F.when(width.isNull(), F.struct(F.lit(0).cast("long").alias("w"), F.col("id").cast("long").alias("b"))).otherwise(
        F.struct(width.alias("w"), F.floor(F.col("ts_us") / width).alias("b"))
    )
    order = W.partitionBy(window, "__bucket").orderBy(F.desc("changed"), F.desc("ts_us"), F.desc("id"))
    kept = pictures.withColumn("__bucket", bucket).withColumn("__rn", F.row_number().over(order))
    return kept.where("__rn = 1").drop("__bucket", "__rn")


def within_budget(pictures: DataFrame, budget: int, device: str = "device") -> DataFrame:
    """Newest whole days of each device while their bytes, counted once for each digest, stay in 90 % of the budget."""
    first = W.partitionBy(device, "digest").orderBy(F.desc("ts_us"), F.desc("id"))
    sized = pictures.withColumn("__bytes", F.when(F.row_number().over(first) == 1, F.col("bytes")).otherwise(0)).withColumn("__day", F.floor(F.col("ts_us") / DAY))
    days = sized.groupBy(device, "__day").agg(F.sum("__bytes").alias("__total"))
    newest = W.partitionBy(device).orderBy(F.desc("__day")).rowsBetween(W.unboundedPreceding, 0)
    stay = days.withColumn("__used", F.sum("__total").over(newest)).where(F.col("__used") * 10 <= F.lit(budget) * 9)
    return sized.join(stay.select(device, "__day"), [device, "__day"], "left_semi").drop("__bytes", "__day")


def picture_usage(pictures: DataFrame) -> DataFrame:
    """Bytes of front and other pictures, each digest once; a digest that a front moment has is a front one."""
    once = pictures.groupBy("digest").agg(F.max("is_front").alias("front"), F.max("bytes").alias("bytes"))
    return once.groupBy("front").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def sequential_drop(rows: DataFrame, key: str, value: str, budget: int) -> DataFrame:
    """Rows of each key in order that fit a budget, those that don't being passed over, not ending it."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, used = None, 0
        for batch in batches:
            keep = []
            for k, v in zip(batch[key], batch[value]):
                if k != own:
                    own, used = k, 0
                keep.append(used + v <= budget)
                used += v if keep[-1] else 0
            yield batch[keep]

    return rows.repartition(key).sortWithinPartitions(key, "ts_us", "id").mapInPandas(fold, rows.schema)
