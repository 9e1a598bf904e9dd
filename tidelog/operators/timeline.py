"""Ordering moments in time: episodes, sessions, segments, days, focus, pauses, health.

Windows are always divided by a device, so a stream of any length stays
distributed; thresholds are parameters, the defaults being minutes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.ranges import before, ranged

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000

#: Sources that show what was also visible, not what had the focus.
NOT_FOCUS = ("screen_context", "transcript_import", "mcp_resource")


def in_order(*keys: str) -> "W":
    return W.partitionBy(*keys).orderBy("ts_us", "id")


def focus(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("kind").isin(*NOT_FOCUS))


def episodes(rows: DataFrame, gap: int = 10 * MINUTE, device: str = "device", is_focus=None) -> DataFrame:
    """rows with `episode`, counted from 1 in each device.

    A focus row begins one if its application differs from the last focus
    row's or more than `gap` has passed since; other rows join the episode they
    fall in, don't move the clock, and open one only if there is none.
    """
    is_focus = F.lit(True) if is_focus is None else is_focus
    order = in_order(device)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    at = lambda c: F.last(F.when(F.col("__focus"), F.col(c)), True).over(before)
    out = rows.withColumn("__focus", is_focus).withColumns({"__ts": at("ts_us"), "__app": at("app"), "__rn": F.row_number().over(order)})
    new = F.col("__ts").isNull() | ~F.col("app").eqNullSafe(F.col("__app")) | (F.col("ts_us") - F.col("__ts") > gap)
    new = (F.col("__focus") & new) | (~F.col("__focus") & (F.col("__rn") == 1))
    out = out.withColumn("episode", F.sum(new.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return out.drop("__focus", "__ts", "__app", "__rn")


def sessions(rows: DataFrame, gap: int = 5 * MINUTE, longest: int | None = 30 * MINUTE, device: str = "device") -> DataFrame:
    """Focus rows (id, ts_us, device) with `session`, counted from 1 in each device.

    A new one begins when at least `gap` has passed since the row before, or at
    least `longest` since the session's first row.  Gaps are a window; the
    second rule depends on earlier cuts, so runs between gaps stream through it
    in order, in constant memory.
    """
    order = in_order(device)
    new = F.coalesce((F.col("ts_us") - F.lag("ts_us").over(order) >= gap).cast("int"), F.lit(1))
    out = rows.select("id", "ts_us", device).withColumn("__new", new)
    out = out.withColumn("__run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__new")
    if longest is None:
        return out.withColumnRenamed("__run", "session")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, start, piece = None, 0, 0
        for batch in batches:
            pieces = np.zeros(len(batch), np.int64)
            for i, (ts, *own) in enumerate(zip(batch["ts_us"], batch[device], batch["__run"])):
                if own != run:
                    run, start, piece = own, ts, 0
                elif ts - start >= longest:
                    start, piece = ts, piece + 1
                pieces[i] = piece
            yield batch.assign(__piece=pieces)

    schema = out.withColumn("__piece", F.lit(0).cast("long")).schema
    sorted_runs = out.repartition(device, "__run").sortWithinPartitions(device, "__run", "ts_us", "id")
    out = sorted_runs.mapInPandas(cut, schema)
    ranked = F.dense_rank().over(W.partitionBy(device).orderBy("__run", "__piece"))
    return out.withColumn("session", ranked).drop("__run", "__piece")


def spans(rows: DataFrame, keys: list[str], what: list[str]) -> DataFrame:
    """Islands of equal `what` within keys: start, end (the next island's start, else the last row), n."""
    order = in_order(*keys)
    changed = [~F.col(c).eqNullSafe(F.lag(c).over(order)) for c in what]
    new = F.lag("id").over(order).isNull()
    for c in changed:
        new = new | c
    marked = rows.withColumn("__new", new.cast("int"))
    marked = marked.withColumn("__n", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    islands = marked.groupBy(*keys, *what, "__n").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n"))
    after = F.lead("start_us").over(W.partitionBy(*keys).orderBy("__n"))
    return islands.withColumn("end_us", F.coalesce(after, "last_us")).drop("last_us", "__n")


def held(rows: DataFrame, cap: int = 2 * MINUTE, tail: int = 0, device: str = "device") -> DataFrame:
    """rows with `held_us`: the time to the next row, at most cap; the last row of a device gets the tail."""
    gap = F.lead("ts_us").over(in_order(device)) - F.col("ts_us")
    return rows.withColumn("held_us", F.coalesce(F.least(gap, F.lit(cap)), F.lit(tail)))


def local_day(ts="ts_us", offset_s: int = 0):
    """Days since the epoch on a clock offset_s ahead of UTC."""
    return F.floor((F.col(ts) + offset_s * SECOND) / DAY)


def local_hour(ts="ts_us", offset_s: int = 0):
    return F.floor(F.pmod(F.col(ts) + F.lit(offset_s * SECOND), F.lit(DAY)) / HOUR).cast("int")


def switches(rows: DataFrame, device: str = "device", what: str = "app") -> DataFrame:
    """For each device and day: changes of `what` between rows, active time, and switches an hour (at least 1/4 h)."""
    order = in_order(device)
    changed = (F.lag(what).over(order).isNotNull() & (F.col(what) != F.lag(what).over(order))).cast("long")
    timed = held(rows, device=device).withColumn("__changed", changed)
    out = timed.groupBy(device, local_day().alias("day")).agg(F.sum("__changed").alias("switches"), F.sum("held_us").alias("active_us"))
    return out.withColumn("per_hour", F.round(F.col("switches") / F.greatest(F.col("active_us") / HOUR, F.lit(0.25)), 6))


def back_and_forth(rows: DataFrame, device: str = "device", what: str = "app") -> DataFrame:
    """Unordered pairs A, B seen as A, B, A: the first sighting counts two, each more one; kept from three."""
    order = in_order(device)
    one, two = F.lead(what, 1).over(order), F.lead(what, 2).over(order)
    triples = rows.select(device, F.col(what).alias("a"), one.alias("b"), two.alias("c")).where("a = c and a <> b")
    pairs = triples.groupBy(device, F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"))
    return pairs.agg((F.count("*") + 1).alias("times")).where("times >= 3")


def day_breakdown(rows: DataFrame, device: str = "device", top_apps: int = 12) -> DataFrame:
    """Time of each application, day and start hour; per day at most `top_apps` applications, longest first."""
    timed = held(rows, device=device).withColumns({"day": local_day(), "hour": local_hour()})
    per_app = timed.groupBy(device, "day", "app").agg(F.sum("held_us").alias("app_us"))
    ranked = per_app.withColumn("rank", F.row_number().over(W.partitionBy(device, "day").orderBy(F.desc("app_us"), "app")))
    return ranked.where(F.col("rank") <= top_apps)


def top_per_hour(rows: DataFrame, device: str = "device") -> DataFrame:
    timed = held(rows, device=device).withColumns({"day": local_day(), "hour": local_hour()})
    per = timed.groupBy(device, "day", "hour", "app").agg(F.sum("held_us").alias("held_us"))
    best = F.row_number().over(W.partitionBy(device, "day", "hour").orderBy(F.desc("held_us"), "app"))
    return per.withColumn("__r", best).where("__r = 1").drop("__r")


def focus_blocks(rows: DataFrame, slot: int = 5 * MINUTE, least: int = 5, cap: int = 2 * MINUTE, device: str = "device", kind: str = "app") -> DataFrame:
    """Runs of at least `least` slots, each active for half its length, with one dominant kind.

    A row's time counts in the slot in which it begins; of equally long kinds
    the later in the order of names dominates.
    """
    timed = held(rows, cap, device=device).withColumn("slot", F.floor(F.col("ts_us") / slot))
    per = timed.groupBy(device, "slot", kind).agg(F.sum("held_us").alias("us"))
    slots = per.groupBy(device, "slot").agg(F.sum("us").alias("total"), F.max(F.struct("us", F.col(kind).alias("kind")))["kind"].alias("kind"))
    good = slots.where(F.col("total") * 2 >= slot)
    order = W.partitionBy(device).orderBy("slot")
    new = F.coalesce((F.col("slot") != F.lag("slot").over(order) + 1) | (F.col("kind") != F.lag("kind").over(order)), F.lit(True))
    islands = good.withColumn("__n", F.sum(new.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    blocks = islands.groupBy(device, "__n", "kind").agg(F.min("slot").alias("first_slot"), F.count("*").alias("slots"), F.sum("total").alias("active_us"))
    return blocks.where(F.col("slots") >= least).drop("__n")


def activity_label(keys, clicks, scrolls, minutes):
    """What the input counts of a segment say it was; the length counts as a quarter of a minute at least."""
    m = F.greatest(minutes, F.lit(0.25))
    return (
        F.when(keys / m >= 25, "typing")
        .when((scrolls / m >= 3) & (keys / m < 10), "reading")
        .when((clicks / m >= 4) & (keys / m < 10), "clicking")
        .when(keys > 0, "typing a little")
        .otherwise("looking")
    )


def as_of(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: int, inclusive: bool = True) -> DataFrame:
    """left with the latest right value of the same key at or before it, at most `tolerance` older.

    Both sides go through one window over their union: one shuffle, no join.
    """
    rows = left.withColumns({"__side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(key, "ts_us", value).withColumn("__side", F.lit(0 if inclusive else 2)), allowMissingColumns=True
    )
    order = W.partitionBy(key).orderBy("ts_us", "__side").rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("__side") != 1, F.struct(F.col("ts_us").alias("t"), F.col(value).alias("v"))), True).over(order)
    out = rows.withColumn("__seen", seen).where("__side = 1")
    fresh = F.col("ts_us") - F.col("__seen.t") <= tolerance
    return out.withColumn(value, F.when(fresh, F.col("__seen.v"))).drop("__side", "__seen")


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, width: int) -> DataFrame:
    """Points joined to the half-open intervals of their key that hold them; empty intervals last one microsecond.

    Intervals are dealt to every bucket of `width` they touch, points to one, so
    the join is on key and bucket, never a product.
    """
    end = F.greatest("end_us", F.col("start_us") + 1)
    buckets = F.sequence(F.floor(F.col("start_us") / width), F.floor((end - 1) / width))
    dealt = intervals.withColumn("__b", F.explode(buckets))
    own = points.withColumn("__b", F.floor(F.col("ts_us") / width))
    return own.join(dealt, [key, "__b"]).where((F.col("ts_us") >= F.col("start_us")) & (F.col("ts_us") < end)).drop("__b")


def near_pairs(rows: DataFrame, key: str, width: int, different: str) -> DataFrame:
    """Pairs of a key at most `width` apart in time that differ in `different`, each once, earlier first.

    Rows meet in buckets of `width`: each in its own and the one before.
    """
    a = rows.select(key, *[F.col(c).alias(f"{c}_a") for c in ("ts_us", "id", different)]).withColumn("__b", F.floor(F.col("ts_us_a") / width))
    b = rows.select(key, *[F.col(c).alias(f"{c}_b") for c in ("ts_us", "id", different)]).withColumn("__own", F.floor(F.col("ts_us_b") / width))
    b = b.withColumn("__b", F.explode(F.array("__own", F.col("__own") - 1)))
    close = (F.col("ts_us_b") - F.col("ts_us_a") <= width) & (F.struct("ts_us_a", "id_a") < F.struct("ts_us_b", "id_b"))
    return a.join(b, [key, "__b"]).where(close & (F.col(f"{different}_a") != F.col(f"{different}_b"))).drop("__b", "__own")


def collapsed_repeats(rows: DataFrame, key: str, text: str, within: int = MINUTE, remembered: int = 8) -> DataFrame:
    """Rows left after dropping those that repeat one of the last `remembered` kept rows of their key.

    A repeat has the same text but for ASCII case and is less than `within`
    younger.  Whether a row is kept depends on kept rows, so rows stream by in
    the order of (key, time, id), and a task holds `remembered` of one key.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, kept = None, []
        for batch in batches:
            mask = []
            for own, ts, x in zip(batch[key], batch["ts_us"], batch[text]):
                if not kept or own != of:
                    of, kept = own, []
                x = (x or "").translate(_ASCII_LOWER)
                mask.append(not any(x == old and ts - at < within for at, old in kept))
                if mask[-1]:
                    kept = [*kept, (ts, x)][-remembered:]
            yield batch[mask]

    ordered = rows.repartition(key).sortWithinPartitions(key, "ts_us", "id")
    return ordered.mapInPandas(stream, rows.schema)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def health(rows: DataFrame, counter: str, device: str = "device") -> DataFrame:
    """Sum of a counter's growth per device; where it falls it was restarted and counts from zero."""
    before = F.lag(counter).over(in_order(device))
    grown = F.when(before.isNull(), F.lit(0)).when(F.col(counter) < before, F.col(counter)).otherwise(F.col(counter) - before)
    restarted = F.coalesce(F.col(counter) < before, F.lit(False)).cast("long")
    marked = rows.withColumns({"__grown": grown, "__restarted": restarted})
    return marked.groupBy(device).agg(F.sum("__grown").alias("growth"), F.sum("__restarted").alias("restarts"))


def distribution(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """min, nearest-rank p50 and p95, max and mean of each key; rank index ((n - 1) p + 50) div 100."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))  # equal values meet before the shuffle
    rows = before(ranged(counted, value, keys), keys, {"__before": F.col("__c")})
    upto = F.col("__before") + F.sum("__c").over(W.partitionBy(*keys, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("__upto", upto)
    place = lambda p: F.floor(((F.col("__before_all") - 1) * p + 50) / 100)
    at = lambda p: F.max(F.when((place(p) < F.col("__upto")) & (place(p) >= F.col("__upto") - F.col("__c")), F.col(value)))
    mean = F.sum(F.col(value) * F.col("__c")) / F.sum("__c")
    return placed.groupBy(*keys).agg(F.min(value).alias("least"), at(50).alias("p50"), at(95).alias("p95"), F.max(value).alias("most"), F.round(mean, 6).alias("mean"))


def downsampled(rows: DataFrame, per: int, start: int, end: int, device: str = "device", preferred=None) -> DataFrame:
    """One row for each bucket of max(range / per, 1 minute): the first preferred row, else the first."""
    width = max((end - start) // per, MINUTE)
    bucket = F.floor((F.col("ts_us") - start) / width)
    best = F.lit(0) if preferred is None else F.when(preferred, 0).otherwise(1)
    kept = rows.where(F.col("ts_us").between(start, end)).withColumn("bucket", bucket)
    order = W.partitionBy(device, "bucket").orderBy(best, "ts_us", "id")
    return kept.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
