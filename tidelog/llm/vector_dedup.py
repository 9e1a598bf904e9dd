"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are made unit length and rotated onto the principal axes of all
vectors, largest variance first.  A link at cosine t means a distance of at
most r = sqrt(2 - 2t), so linked vectors lie in equal or neighbouring cells of
width r of the leading axes: two, and one more for each threefold of vectors
beyond 64 tiles, up to six.  Cells are split into tiles of bounded size
and only tiles of neighbouring cells meet: their keys are paired first, then
the vectors fetched by tile, so that a crowded cell spreads over tasks.  In a pair of tiles dot products
accumulate over the leading dimensions; what the rest can add is at most the
product of the two suffix norms, and a pair is given up once the sum of both
cannot reach t.  Survivors are decided on the vectors as they came, in double
precision.

Equal vectors of a label are one class first.  A pair of tiles returns sums of
links for each class and a spanning forest of its links, never the links
themselves, so a dense group costs arithmetic but no rows.

Only vectors with equal, non-null labels and equal length link.  Vectors that
are null, empty, zero or hold null or non-finite components, or whose id is
null, link with nothing: no links, their own id as component, kept.  Repeated
rows with one id are one node with a link for each other row of another id.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, connected_components, forest, sized

TILE = 2048
#: Dimensions after which a pair of tiles looks again whether any product can still reach the threshold.
STEPS = (8, 16, 32)


def packed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, key, vec): vec is the vector as bytes of doubles, key its digest; both null if it takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [], []
            for x, i, label in zip(batch.column(1), batch.column(0), batch.column(2)):
                raw = key = None
                if x.is_valid and len(x) and not x.values.null_count and i.is_valid and label.is_valid:
                    v = np.asarray(x.values, np.float64) + 0.0  # -0.0 becomes 0.0
                    if np.isfinite(v).all() and v.any():
                        raw = v.tobytes()
                        key = hashlib.blake2b(raw, digest_size=16).digest()
                keys.append(key)
                vecs.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["id", "label", "key", "vec"])

    rows = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"), F.col(label_col).cast("string"))
    return rows.mapInArrow(run, "id long, label string, key binary, vec binary")


def _units(column) -> np.ndarray:
    """Unit rows from packed vectors of one length; scaled first, so that no square over- or underflows."""
    m = np.frombuffer(b"".join(x.as_py() for x in column), np.float64).reshape(len(column), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length its axes as columns, by decreasing second moment over all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) // 8 for x in batch.column(0)])
            for d in np.unique(sizes):
                u = _units(batch.column(0).filter(pa.array(sizes == d)))
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, s in sums.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], ["d", "i", "j", "s"])

    found = classes.select("vec").mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s"))
    axes = {}
    cells = found.toPandas()  # d * (d + 1) / 2 rows for each length
    for d, own in cells.groupby("d"):
        m = np.zeros((d, d))
        m[own["i"], own["j"]] = m[own["j"], own["i"]] = own["s"]
        axes[int(d)] = np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1])
    return axes


def linked_mask(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with cosine >= threshold.  ra, rb: unit rows along the axes; a, b: unit rows as they came."""
    sofar, at, d = 0, 0, ra.shape[1]
    for step in (*(s for s in STEPS if s < d), d):
        if step == d and at:
            break
        sofar = sofar + ra[:, at:step] @ rb[:, at:step].T
        at = step
        rest_a, rest_b = (np.sqrt(np.maximum(0, 1 - (r[:, :at] ** 2).sum(axis=1))) for r in (ra, rb))
        i, j = np.nonzero(sofar + np.outer(rest_a, rest_b) >= threshold - 1e-9)
        if not len(i) or len(i) * 16 < sofar.size:
            break
    if not len(i):
        return i, j
    if len(i) * 8 < len(a) * len(b):
        cosine = np.concatenate([np.einsum("nd,nd->n", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)])
        good = cosine >= threshold
        return i[good], j[good]
    return np.nonzero(a @ b.T >= threshold)


def _compare(threshold: float, axes: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                same = batch.column(0)[row].as_py()
                ids, counts, units, turned = [], [], [], []
                for side in (1, 2):
                    members = batch.column(side)[row].values
                    ids.append(np.asarray(members.field("rep")))
                    counts.append(np.asarray(members.field("copies")))
                    units.append(_units(members.field("vec")))
                    turned.append(units[-1] @ axes[units[-1].shape[1]])
                i, j = linked_mask(*units, *turned, threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                n = [np.bincount(x, weights=counts[1 - s][y], minlength=len(ids[s])).astype(np.int64) for s, (x, y) in enumerate(((i, j), (j, i)))]
                if same:
                    n = [n[0] + n[1], np.zeros_like(n[1])]
                node = np.concatenate(ids)
                order = np.argsort(node, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                low = forest(place[i], place[j + (0 if same else len(ids[0]))], len(node))
                links = np.concatenate(n)
                at = np.nonzero(links)[0]
                root = node[order][low[place[at]]]
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at]), pa.array(root)], ["rep", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tile: int = TILE, n_axes: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """id, n_links, component_id, kept for each row of vectors; threshold from above 0 to 1."""
    scratch = scratch or Scratch(vectors.sparkSession, "vector-dedup")
    rows = scratch.table(packed(vectors, id_col, vector_col, label_col), "packed")
    classes = scratch.table(
        rows.where("key is not null").groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")),
        "classes",
    )
    axes = principal_axes(classes)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    n_axes = n_axes or min(6, 2 + max(0, math.ceil(math.log(max(1, classes.count()) / (64 * tile), 3))))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) // 8 for x in batch.column(3)])
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                turned = _units(part.column(3)) @ axes[d][:, :n_axes]
                where = np.zeros((len(part), n_axes), np.int32)
                where[:, : turned.shape[1]] = np.floor(turned / width)
                cell = pa.FixedSizeListArray.from_arrays(pa.array(where.reshape(-1)), n_axes).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(part), d, np.int32)), cell], ["label", "rep", "copies", "vec", "d", "cell"])

    celled = scratch.table(
        classes.select("label", "rep", "copies", "vec").mapInArrow(cells, "label string, rep long, copies long, vec binary, d int, cell array<int>"), "cells"
    )
    place = ["label", "d", "cell"]
    sizes = scratch.table(celled.groupBy(*place).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "sizes")
    few = sized(sizes, sizes.count())
    tiled = celled.join(few, place).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    tiled = tiled.repartition(*place, "tile")  # a crowded cell spreads over tasks by its tiles
    tiles = scratch.table(tiled.groupBy(*place, "tile").agg(F.collect_list(F.struct("rep", "copies", "vec")).alias("members")), "tiles")
    # Each cell meets itself and half of its neighbours: those ahead of it in the order of cells.
    ahead = [o for o in itertools.product((-1, 0, 1), repeat=n_axes) if o >= (0,) * n_axes]
    offsets = F.explode(F.array(*[F.array(*map(F.lit, o)) for o in ahead]))
    left = sizes.withColumn("o", offsets).select(
        "label", "d", F.col("cell").alias("own_cell"), F.zip_with("cell", "o", lambda a, b: a + b).alias("cell"), F.col("tiles").alias("own_tiles")
    )
    keys = left.join(few, place).withColumn("own", F.explode(F.expr("sequence(0, own_tiles - 1)")))
    keys = keys.withColumn("tile", F.explode(F.expr("sequence(if(own_cell = cell, own, 0), tiles - 1)"))).drop("tiles", "own_tiles")
    own = tiles.select("label", "d", F.col("cell").alias("own_cell"), F.col("tile").alias("own"), F.col("members").alias("members_a"))
    pairs = keys.join(own, ["label", "d", "own_cell", "own"]).join(tiles, [*place, "tile"])
    pairs = pairs.repartition("label", "d", "own_cell", "own", "cell", "tile")
    pairs = pairs.select(F.expr("own_cell = cell AND own = tile").alias("same"), "members_a", "members")
    partial = scratch.table(pairs.mapInArrow(_compare(threshold, axes), "rep long, links long, root long"), "links")
    component = connected_components(partial.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    linked = partial.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (
        classes.select("label", "key", "rep", "copies")
        .join(linked, "rep", "left")
        .join(component.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    return rows.select("id", "label", "key").join(named, ["label", "key"], "left").select(
        "id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
