"""Reading moments: ranges, cursors, samples, work queues and counts.

Every order is total (time, then id), so equal inputs give equal rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of a snippet, and bytes of a single read.
SNIPPET, TEXT_BYTES, APP_BYTES = 512, 128 * 1024, 1024


def newest(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("ts_us"), F.desc("id")).limit(limit)


def oldest(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy("ts_us", "id").limit(limit)


def in_range(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Both ends belong to the range; an inverted range is an error."""
    if start > end:
        raise ValueError(f"inverted range: {start} > {end}")
    return rows.where(F.col("ts_us").between(start, end))


def since(rows: DataFrame, ts_us: int, limit: int, text: str | None = None) -> DataFrame:
    """Strictly after ts_us, oldest first, texts cut to a snippet."""
    out = oldest(rows.where(F.col("ts_us") > ts_us), limit)
    return out.withColumn(text, F.left(text, F.lit(SNIPPET))) if text else out


def page_after(rows: DataFrame, ts_us: int, id_: int, limit: int) -> DataFrame:
    """Keyset pagination: rows after the pair (ts_us, id)."""
    return oldest(rows.where((F.col("ts_us") > ts_us) | ((F.col("ts_us") == ts_us) & (F.col("id") > id_))), limit)


def after_id(rows: DataFrame, id_: int, limit: int) -> DataFrame:
    return rows.where(F.col("id") > id_).orderBy("id").limit(limit)


def even_sample(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows spread evenly over the order of time within `keys`, the first and the last among them.

    With n = 1 the last stays; with n or fewer rows all stay.  One window over
    an undivided stream runs in one task, so large streams should have keys.
    """
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    out = rows.withColumn("__rn", F.row_number().over(part.orderBy("ts_us", "id"))).withColumn("__n", F.count("*").over(part))
    step = lambda rn: F.floor((rn - 1) * (n - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    rn = F.col("__rn")
    keep = (F.col("__n") <= n) | ((rn == F.col("__n")) if n == 1 else (rn == 1) | (step(rn) > step(rn - 1)))
    return out.where(keep).drop("__rn", "__n")


def spread_pick(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows at positions i * count // n (from 0), i below n, newest last."""
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    out = rows.withColumn("__at", F.row_number().over(part.orderBy("ts_us", "id")) - 1).withColumn("__n", F.count("*").over(part))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("__n") / n))
    return out.where((F.col("__n") <= n) | F.array_contains(wanted, F.col("__at").cast("long"))).drop("__at", "__n")


def by_app(rows: DataFrame, app: str, limit: int) -> DataFrame:
    return newest(rows.where(F.col("app") == app), limit)


def under_url(rows: DataFrame, prefix: str, url: str = "url") -> DataFrame:
    """Rows at an address or below it; slashes at the end of the prefix don't count."""
    root = prefix.rstrip("/")
    return rows.where((F.col(url) == root) | F.col(url).startswith(root + "/"))


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with `kind`, 'unknown' where no source is recorded."""
    return rows.join(sources, "id", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))


def of_source(rows: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
    return rows.join(sources.where(F.col("kind") == kind), "id")


def nearest(rows: DataFrame, target: int, limit: int) -> DataFrame:
    """Closest in time; of two equally close the earlier, then the smaller id."""
    return rows.orderBy(F.abs(F.col("ts_us") - target), "ts_us", "id").limit(limit)


def matching(rows: DataFrame, start: int | None = None, end: int | None = None, app: str | None = None, apps: list[str] | None = None, has_url: bool | None = None) -> DataFrame:
    """The search filters, all of which must hold; an inverted range matches nothing, at most 32 apps are allowed."""
    if apps and len(apps) > 32:
        raise ValueError("at most 32 apps")
    if start is not None and end is not None and start > end:
        return rows.where(F.lit(False))
    tests = [
        start is not None and F.col("ts_us") >= start,
        end is not None and F.col("ts_us") <= end,
        app is not None and F.col("app") == app,
        apps and F.col("app").isin(apps),
        has_url is not None and (F.col("url").isNotNull() if has_url else F.col("url").isNull()),
    ]
    return reduce(DataFrame.where, (t for t in tests if t is not False and t is not None and not isinstance(t, list)), rows)


def capped_text(rows: DataFrame, id_: int, text: str = "text") -> DataFrame:
    """One moment's text of at most TEXT_BYTES bytes, never cut inside a character."""
    head = F.make_valid_utf8(F.substring(F.col(text).cast("binary"), 1, TEXT_BYTES).cast("string"))
    whole = F.octet_length(text) <= TEXT_BYTES
    fits = F.when(whole, F.col(text)).otherwise(F.regexp_replace(head, "\ufffd+$", ""))
    return rows.where(F.col("id") == id_).withColumn(text, fits)


def without(rows: DataFrame, done: DataFrame, on: str = "id") -> DataFrame:
    """A work queue: rows with no match in `done`."""
    return rows.join(done.select(on), on, "left_anti")


def unread(rows: DataFrame, readings: DataFrame, version: int, limit: int) -> DataFrame:
    """Newest rows that have no reading of the current version."""
    return newest(without(rows, readings.where(F.col("version") == version)), limit)


def replaced(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Replace by key: rows of `new`, and of `old` those whose key `new` doesn't have."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_per_group(rows: DataFrame, n: int, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def reconcile(stored: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """(action, key): 'delete' for stored rows no longer wanted, 'insert' for wanted rows not stored."""
    gone = stored.join(wanted, key, "left_anti").select(F.lit("delete").alias("action"), key)
    return gone.union(wanted.join(stored, key, "left_anti").select(F.lit("insert").alias("action"), key))


def valid(rows: DataFrame, dimension: int | None = None, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) moments: an id and a time are needed, and a vector of the right size if any."""
    good = F.col("id").isNotNull() & F.col("ts_us").isNotNull()
    if dimension is not None:
        good &= F.col(vector).isNull() | (F.size(vector) == dimension)
    good = F.coalesce(good, F.lit(False))
    return rows.where(good), rows.where(~good)


def observed_apps(rows: DataFrame, limit: int) -> DataFrame:
    return rows.groupBy("app").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "app").limit(limit)


def storage_stats(rows: DataFrame) -> DataFrame:
    """Counts and times of screen moments, in one pass."""
    screen = F.col("kind").isin("screen", "screen_context")
    return rows.agg(
        F.count_if(screen).alias("n_screen"), F.max(F.when(screen, F.col("ts_us"))).alias("last_screen_us"), F.count_if(F.col("kind") == "page").alias("n_page")
    )


def progress(rows: DataFrame, readings: DataFrame, version: int) -> DataFrame:
    joined = rows.join(readings.groupBy("id").agg(F.max("version").alias("version")), "id", "left")
    return joined.agg(F.count_if(F.coalesce(F.col("version") == version, F.lit(False))).alias("current"), F.count_if(F.col("version").isNull()).alias("never"))


def distinct_per_key(rows: DataFrame, key: str, item: str, limit: int) -> DataFrame:
    """Distinct items of each key, most first: for instance the moments in which a file path was seen."""
    return rows.groupBy(key).agg(F.countDistinct(item).alias("n")).orderBy(F.desc("n"), key).limit(limit)


def co_occurring(mentions: DataFrame, moment: str = "event_id", entity: str = "entity_id") -> DataFrame:
    """The sorted distinct entities of each moment with at least two."""
    lists = mentions.groupBy(moment).agg(F.sort_array(F.collect_set(entity)).alias("entities"))
    return lists.where(F.size("entities") >= 2)


def coalesced_ranges(rows: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Half-open ranges of each key, those that overlap or touch merged."""
    order = W.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1))
    islands = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def overlapping(rows: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Rows that begin before an earlier row of their key has ended."""
    reach = F.max(end).over(W.partitionBy(key).orderBy(start, end, "id").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("__reach", reach).where(F.col(start) < F.col("__reach")).drop("__reach")
