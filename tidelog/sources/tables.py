"""Reading tables, and the given tables as the engine's own model of moments."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a moment: id, time in microseconds, application, device, a measured value, a numeric signal.
MOMENT = ("id", "ts_us", "app", "device", "value", "k")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts):
    """Microseconds since the epoch; time stamps without a zone count as UTC (the session zone must be UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as moments: event type for application, user for device."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        micros("ts").alias("ts_us"),
        F.col("event_type").alias("app"),
        F.col("user_id").alias("device"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


#: The same in SQL, to begin a WITH list.
MOMENTS_SQL = "m AS (SELECT event_id AS id, epoch_us(ts) AS ts_us, event_type AS app, user_id AS device, value, (props::JSON ->> '$.k')::INTEGER AS k FROM events)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind): how each moment was acquired; moments with k = 0 (mod 7) have no row."""
    k = F.col("k") % 7
    return moments(spark, sf_dir).where(k != 0).select("id", F.element_at(F.array(*map(F.lit, KINDS)), k.cast("int")).alias("kind"))


KINDS = ("screen", "screen_context", "page", "transcript_import", "mcp_resource", "mail")

SOURCES_SQL = f"src AS (SELECT id, list_extract({list(KINDS)}, k % 7) AS kind FROM m WHERE k % 7 <> 0)"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; only a local master may do without, in a new folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def checkpointed(spark: SparkSession):
    """A function that cuts a DataFrame's lineage by an eager checkpoint in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return lambda df: df.checkpoint()


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _file_system(spark, path)
    return system.exists(where)


def is_file(spark: SparkSession, path: str) -> bool:
    where, system = _file_system(spark, path)
    return system.getFileStatus(where).isFile()


def rename(spark: SparkSession, old: str, new: str) -> None:
    """old as new, unless new is there already."""
    where, system = _file_system(spark, old)
    if not exists(spark, new):
        system.rename(where, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new))


def file_marks(spark: SparkSession, files: list[str]) -> list[str]:
    """Path, length and time of each file."""
    out = []
    for file in sorted(files):
        where, system = _file_system(spark, file)
        status = system.getFileStatus(where)
        out.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return out
