"""Shared plumbing: written intermediate tables, connected components, sized joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a two-column key list is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
#: Edges up to which one task finds all components: 16 bytes each, and a few times that to work on.
ONE_TASK_EDGES = 2_000_000
#: Spark's setting to remove a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Only a local master may do without: a new folder is set then."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts lineage and survives lost executors.  The operator's
    result still reads the tables, so they go only when close() is called.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = ready(spark), f"{shared_root(spark)}/tidelog/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:02d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df as a written table; the shuffle files behind it go with the job, as nothing reads them any more."""
        path, before = self.path(name), self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self, df: DataFrame) -> None:
        """Delete a table written by table() that nothing reads any more."""
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(self.spark, file)

    def close(self) -> None:
        _delete(self.spark, self.root)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when the counted rows are few enough, else no hint (a shuffled join)."""
    return F.broadcast(df) if rows <= limit else df


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 .. n-1 the smallest node reachable over the pairs (i, j)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        np.minimum.at(new, low, new)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if len(b)]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts))
        ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = ids[forest(where[: len(a)], where[len(a) :], len(ids))]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], ["id", "component"])


def connected_components(edges: DataFrame, scratch: Scratch, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Columns (id, component): the smallest id reachable over edges (a, b), for every id on one.

    Up to `one_task` edges, counted first, an executor's task joins them in
    memory.  Beyond that, alternating large-star and small-star rounds run;
    each round's edges are a written table, and only a count and a checksum of
    them reach the driver.
    """
    tidy = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    cur = scratch.table(tidy, "edges")
    if cur.count() <= one_task:
        return scratch.table(cur.coalesce(1).mapInArrow(_in_one_task, "id long, component long"), "components")
    cur = scratch.table(cur.distinct(), "edges")

    def mark(df: DataFrame):
        row = df.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first()
        return row[0], row[1]

    seen = mark(cur)
    while seen[0]:
        both = cur.union(cur.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        new = scratch.table(small.where("u <> v").distinct(), "edges")
        scratch.delete(cur)
        cur, last, seen = new, seen, mark(new)
        if seen == last:
            break
    stars = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
