"""Moments as a stream: reading files, validating, dropping replays, sessions, a page cache.

Ids are deterministic and every step is keyed by them, so a replayed file adds
nothing.  `split` writes each batch once, to what is in time, what is late and
what is refused; a row is late if it is no newer than the newest row of earlier
batches less the lateness allowed.  Streams over what is in time, read in the
order it was written, then lose nothing to their watermarks, which are no later.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.tables import exists, is_file, shared_folder

#: How late a moment may come.
LATE = "10 minutes"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    return f"{shared_folder(spark)}/tidelog-stream/{name}-{uuid.uuid4().hex}"


def files(spark: SparkSession, folder: str, pattern: str, schema, kind: str = "parquet", per_batch: int = 64) -> DataFrame:
    """A stream of the files of a folder whose names match, each read once."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch)
    return reader.format(kind).load(folder)


def table_files(spark: SparkSession, sf_dir: str, name: str, schema, per_batch: int = 64) -> DataFrame:
    """A stream of a table's files, be it one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    if is_file(spark, path):
        return files(spark, sf_dir, f"{name}.parquet", schema, per_batch=per_batch)
    return files(spark, path, "*.parquet", schema, per_batch=per_batch)


@dataclass(frozen=True)
class Split:
    """What `split` wrote: rows in time as a stream in their order, late ones, and refused ones with their problem."""

    in_time: DataFrame
    late: DataFrame
    refused: DataFrame


def split(rows: DataFrame, name: str, ts: str = "ts", late: str = LATE) -> Split:
    """Drain a stream (with `problem`, or all good) into three folders, each batch once.

    How far each batch came is kept beside the stream's state, so a restart
    decides as before, and a batch that is written again overwrites itself.
    """
    spark, root = rows.sparkSession, shared_path(rows.sparkSession, name)
    rows = rows if "problem" in rows.columns else rows.withColumn("problem", F.lit(None).cast("string"))
    schema = rows.drop("problem").schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema("number long, newest timestamp").parquet(f"{root}/newest") if exists(spark, f"{root}/newest") else None
        newest = None if seen is None else seen.where(F.col("number") < number).agg(F.max("newest")).first()[0]
        batch = batch.persist()
        is_late = F.lit(False) if newest is None else F.col(ts) <= F.lit(newest) - F.expr(f"INTERVAL {late}")
        good = batch.where("problem is null")
        for kind, own in (("in_time", good.where(~is_late).drop("problem")), ("late", good.where(is_late).drop("problem")), ("refused", batch.where("problem is not null"))):
            own.write.mode("overwrite").parquet(f"{root}/{kind}/batch={number:08d}")
        good.agg(F.max(ts).alias("newest")).select(F.lit(number).alias("number"), "newest").coalesce(1).write.mode("overwrite").parquet(f"{root}/newest/batch={number:08d}")  # one row
        batch.unpersist()

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    read = lambda kind, of: spark.read.schema(of).option("recursiveFileLookup", True).parquet(f"{root}/{kind}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/in_time")
    return Split(stream, read("late", schema), read("refused", rows.schema))


def valid(rows: DataFrame, kinds: list[str], kind: str = "event_type", ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """rows with `problem`: null for a good row, else why it is refused."""
    problem = F.when(F.col(id_).isNull(), "no id").when(F.col(ts).isNull(), "no time").when(F.col(kind).isNull() | ~F.col(kind).isin(kinds), "unknown kind")
    return rows.withColumn("problem", problem)


def once(rows: DataFrame, ts: str = "ts", id_: str = "event_id", late: str = LATE) -> DataFrame:
    """Replays dropped: the first row of each id within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_])


def session_counts(rows: DataFrame, gap: str, keys: list[str], ts: str = "ts", late: str = LATE) -> DataFrame:
    """Sessions of each key that close when `gap` has passed: begin, last, n."""
    windowed = rows.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return windowed.agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(*keys, F.col("w.start").alias("begin"), "last", "n")


def slot_counts(rows: DataFrame, width: str, keys: list[str], ts: str = "ts", late: str = LATE) -> DataFrame:
    windowed = rows.withWatermark(ts, late).groupBy(*keys, F.window(ts, width).alias("w"))
    return windowed.agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("begin"), "n")


def with_page_text(frames: DataFrame, pages: DataFrame, ttl: str, url: str = "url", ts: str = "ts", late: str = LATE) -> DataFrame:
    """Frames joined to the page texts of their address seen up to `ttl` before; keep the newest of each frame afterwards."""
    f = frames.withWatermark(ts, late).alias("f")
    p = pages.withWatermark(ts, late).alias("p")
    near = (F.col(f"p.{ts}") <= F.col(f"f.{ts}")) & (F.col(f"p.{ts}") >= F.col(f"f.{ts}") - F.expr(f"INTERVAL {ttl}"))
    return f.join(p, (F.col(f"f.{url}") == F.col(f"p.{url}")) & near, "leftOuter").select("f.*", F.col("p.text").alias("page_text"), F.col(f"p.{ts}").alias("page_ts"))


def drained(rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, then read what it wrote."""
    spark = rows.sparkSession
    root = shared_path(spark, name)
    writer = rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/state")
    writer.trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out")


def routed(rows: DataFrame, name: str, good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None]) -> None:
    """Each batch once to both sinks: rows without and with a problem."""
    root = shared_path(rows.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        good(batch.where("problem is null"), number)
        bad(batch.where("problem is not null"), number)

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()


def transcripts(spark: SparkSession, folder: str, schema, per_batch: int = 64) -> DataFrame:
    """A stream of JSON lines; a line that can't be read (for instance an unfinished last one) has all fields null but `_bad`."""
    full = schema if "_bad" in schema.fieldNames() else schema.add("_bad", "string")
    return spark.readStream.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", per_batch).json(folder)


def export_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("errorifexists").json(path)
