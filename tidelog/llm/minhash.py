"""MinHash near-duplicates by fast similarity sketching.

A sketch has t coordinates.  Round i hashes every shingle to one bin and keeps
the smallest value of round i in the bins no earlier round filled; from round t
on, round i sends all shingles to bin i - t, so after 2t rounds each bin is
full, however small the set.  Large sets fill up in the first rounds.  The
matching share of coordinates concentrates about the Jaccard similarity as for
k independent minima (Dahlgaard, Knudsen and Thorup, 2017).

Bands of coordinates give candidates.  Documents with equal shingle sets form
one class first.  In each bucket all members are tried against its smallest
one.  Buckets whose members then lie in several components are open: in small
ones all pairs of different components are tried; the members of large ones
are gathered into clusters that hold whole buckets, and a cluster's sets meet
in tiles of bounded size, which return a spanning forest of their links.  So
every pair that shares a band is tried or joined already, and a large group of
copies makes blocks of arithmetic, not rows.  Every link is confirmed on the
full shingle sets.

Nulls and empties: a null or empty text has an empty set and links with
nothing.  A row with a null id takes no part: its component is null and it is
kept.  Rows with one id are one document, whose texts all link: repeated rows
share a component, and of an id that stays, `without_near_duplicates` keeps
each text once.  Very long texts are sets like any other.  Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, connected_components, forest, sized
from tidelog.llm.words import hashes_of, mix, runs, words_of

#: Shingles that are sketched together in one worker.
CHUNK = 1_000_000
#: Members from which on an open bucket is a crowd, and the sets and bytes of a tile of a cluster of crowds.
CROWD, TILE_SETS, TILE_BYTES = 16, 512, 2 << 20


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles of the lower-cased text."""
    h = hashes_of(words_of(text, lower=True))
    return np.unique(runs(h, min(k, len(h)))) if len(h) else h


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Row d: the t coordinates of set d, each (round << 32 | value); sets must not be empty."""
    n, x = len(sets), np.concatenate(sets) if sets else np.empty(0, np.uint64)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            h = mix(x + np.uint64(i + 1) * np.uint64(0xD1B54A32D192ED03))
            low = h & np.uint64(0xFFFFFFFF)
            place = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
            np.minimum.at(out, row * t + place, low | np.uint64(i << 32))
            open_rows = (out.reshape(n, t) == np.iinfo(np.uint64).max).any(axis=1)
            if not open_rows.any():
                break
            still = open_rows[row]
            x, row = x[still], row[still]
    return out.reshape(n, t)


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    n, t = sketch.shape
    part = sketch.reshape(n, bands, t // bands)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, bands)).copy()
        for j in range(t // bands):
            out = mix(out ^ part[:, :, j])
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, set_key, buckets): set_key names the set, buckets its bands; both null when it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                sets, total, start = [], 0, at
                while at < len(texts) and total < CHUNK:
                    sets.append(shingle_set(texts[at].as_py(), k))
                    total, at = total + len(sets[-1]), at + 1
                full = [s for s in sets if len(s)]
                found = iter(band_hashes(sketches(full, bands * rows), bands).view(np.int64))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, at - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "n_shingles", "set_key", "buckets"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "id long, n_shingles long, set_key binary, buckets array<bigint>"
    )


def full_sets(docs: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """(id, words): the sorted shingle hashes of the wanted (id, set_key, node), packed as bytes; here id is the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(x.as_py(), k).tobytes() for x in part.column(1)]
                keys = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                right = [k == w.as_py() for k, w in zip(keys, part.column(2))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(3), pa.array(sets, pa.binary())], ["id", "words"]
                ).filter(pa.array(right))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(wanted, "id").select("id", "text", "set_key", "node").mapInArrow(run, "id long, words binary").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("b"), F.col("words").alias("words_b"))
    right = sets.select(F.col("id").alias("a"), F.col("words").alias("words_a"))
    joined = pairs.select("a", "b").join(left, "b").join(right, "a").select("a", "b", "words_a", "words_b")
    return joined.mapInArrow(run, "a long, b long")


def tile_links(sets: list[np.ndarray], percent: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of linked sets; with split, only between those before it and those from it on.

    Shingles that no other set here has can't be in an intersection: a set with
    too many of them is left out before the products are formed.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[where] > 1
    open_ = np.bincount(owner[common], minlength=len(sets)) * 100 >= sizes * percent
    keep = common & open_[owner]
    owner, column = owner[keep], np.unique(where[keep], return_inverse=True)[1]
    row = np.cumsum(open_) - 1
    left = open_.copy() if split is None else open_ & (np.arange(len(sets)) < split)
    right = open_ if split is None else open_ & (np.arange(len(sets)) >= split)
    both = np.zeros((int(open_.sum()), int(open_.sum())), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = row[owner[order]], column[order]
    width = max(1, 8_000_000 // max(1, len(both)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(both), width), np.float32)
        part[owner[i:j], column[i:j] - at] = 1
        both += part @ part.T
    n = sizes[open_]
    total = n[:, None] + n[None, :] - both
    good = (100 * both.astype(np.int64) >= percent * total.astype(np.int64)) & (left[open_][:, None] & right[open_][None, :])
    if split is None:
        good = np.triu(good, 1)
    i, j = np.nonzero(good)
    back = np.nonzero(open_)[0]
    return back[i], back[j]


def crowded(cluster: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): a spanning forest of the links within each cluster, tile by tile.  cluster: (rep, cluster)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                same = batch.column(0)[row].as_py()
                sides = [batch.column(c)[row].values for c in ((1,) if same else (1, 2))]
                ids = np.concatenate([np.asarray(s.field("id")) for s in sides])
                words = [np.frombuffer(x.as_buffer(), np.uint64) for s in sides for x in s.field("words")]
                i, j = tile_links(words, percent, None if same else len(sides[0]))
                low = forest(i, j, len(ids))
                at = np.nonzero(low != np.arange(len(ids)))[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[low[at]])], ["a", "b"])

    rows = scratch.table(cluster.join(sets.withColumnRenamed("id", "rep"), "rep"), "clustered")
    bytes_ = rows.groupBy("cluster").agg(F.sum(F.length("words")).alias("bytes"), F.count("*").alias("n"))
    tiles = F.ceil(F.greatest(F.col("bytes") / TILE_BYTES, F.col("n") / TILE_SETS))
    counts = scratch.table(bytes_.select("cluster", tiles.alias("tiles")), "clusters")
    dealt = rows.join(sized(counts, counts.count()), "cluster")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    dealt = dealt.repartition("cluster", "tile")  # a large cluster spreads over tasks by its tiles
    packed = dealt.groupBy("cluster", "tile").agg(F.collect_list(F.struct(F.col("rep").alias("id"), "words")).alias("sets"))
    packed = scratch.table(packed, "tiles")
    # Keys of tiles are paired first, then the sets fetched by tile: a large cluster's pairs spread over tasks.
    keys = counts.withColumn("own", F.explode(F.expr("sequence(0, int(tiles) - 1)"))).repartition("cluster", "own")
    keys = keys.withColumn("tile", F.explode(F.expr("sequence(own, int(tiles) - 1)"))).drop("tiles")
    left = packed.select("cluster", F.col("tile").alias("own"), F.col("sets").alias("sets_a"))
    pairs = keys.join(left, ["cluster", "own"]).join(packed, ["cluster", "tile"]).repartition("cluster", "own", "tile")
    pairs = pairs.select(F.expr("own = tile").alias("same"), "sets_a", "sets")
    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    bands: int = 24,
    rows: int = 5,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    Links are pairs with 100 * intersection >= percent * union of their k-word
    shingle sets.  With 24 bands of 5 a pair at 0.85 is missed with a chance of
    8e-7 and one at 0.80 of 7e-5; more bands lower it.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    sig = scratch.table(signatures(docs, id_col, text_col, k, bands, rows), "signatures")
    classes = scratch.table(
        sig.where("set_key is not null and id is not null")
        .groupBy("set_key")
        .agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets")),
        "classes",
    )
    # Ids with several sets: their classes are one document.  A class whose smallest id is taken gets a stand-in.
    several = sig.where("set_key is not null and id is not null").groupBy("id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi"))
    several = scratch.table(several.where("lo <> hi").select("id"), "several")
    n_several = several.count()
    classes = classes.withColumn("first_id", F.col("rep"))
    if n_several:
        held = sig.where("set_key is not null").join(sized(several, n_several), "id").select("id", "set_key").distinct()
        held = held.join(classes.select("set_key", "rep"), "set_key")
        first = held.where("id = rep").groupBy("id").agg(F.min("set_key").alias("set_key")).withColumn("own", F.lit(True))
        node = F.when(F.col("own") | (F.col("id") != F.col("rep")), F.col("rep")).otherwise(F.xxhash64("set_key").bitwiseOR(F.lit(1 << 62)))
        held = scratch.table(held.join(first, ["id", "set_key"], "left").select("id", "set_key", "rep", node.alias("node")), "held")
        stand_in = held.where("node <> rep").select("set_key", "node")
        classes = classes.join(stand_in, "set_key", "left").withColumn("rep", F.coalesce("node", "rep")).drop("node")
        classes = scratch.table(classes, "classes")
        same = held.join(stand_in.withColumnRenamed("node", "other"), "set_key", "left").select(F.col("id").alias("a"), F.coalesce("other", "node").alias("b"))
    spread = classes.select(F.explode("buckets").alias("bucket"), "rep", "n")
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n")).alias("pivot")).where("size > 1")
    members = scratch.table(spread.join(shared, "bucket").select("bucket", "rep", "n", "size", "pivot"), "members")
    wanted = scratch.table(members.select(F.col("rep").alias("id")).distinct(), "wanted")
    n_wanted = wanted.count()
    # A list of ids that is small enough is broadcast; else the texts are shuffled to it.
    keyed = classes.select(F.col("rep").alias("node"), "set_key", F.col("first_id").alias("id")).join(wanted.withColumnRenamed("id", "node"), "node", "left_semi")
    sets = scratch.table(full_sets(docs, id_col, text_col, k, sized(keyed, n_wanted)), "sets")
    near = lambda m, n: F.least(m, n) * 100 >= F.greatest(m, n) * percent  # noqa: E731  else the sizes rule a link out
    pairs = members.where(F.col("rep") != F.col("pivot.rep")).where(near(F.col("n"), F.col("pivot.n")))
    pairs = pairs.select(F.col("pivot.rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = scratch.table(confirmed(pairs, sets, percent), "links")
    component = connected_components(links, scratch)
    side = members.join(component.withColumnRenamed("id", "rep"), "rep", "left")
    side = side.select("bucket", "rep", "n", "size", F.coalesce("component", "rep").alias("component"))
    several = side.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("first"))
    side = scratch.table(side.join(several.where("lo <> hi").select("bucket", "first"), "bucket"), "open")
    crowds = side.where(F.col("size") > CROWD)
    cluster = connected_components(crowds.select(F.col("rep").alias("a"), F.col("first").alias("b")), scratch)
    cluster = cluster.select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
    few = side.where(F.col("size") <= CROWD).join(cluster, "rep", "left")
    other = few.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("rep", "n", "component", "cluster")])
    pairs = few.join(other, "bucket").where(
        (F.col("rep") < F.col("rep_b"))
        & (F.col("component") != F.col("component_b"))
        & near(F.col("n"), F.col("n_b"))
        & ~F.coalesce(F.col("cluster") == F.col("cluster_b"), F.lit(False))
    )
    more = confirmed(pairs.select(F.col("rep").alias("a"), F.col("rep_b").alias("b")).distinct(), sets, percent)
    links = links.union(scratch.table(more.union(crowded(cluster, sets, percent, scratch)), "links"))
    if n_several:
        links = links.union(same)
    component = connected_components(links, scratch)
    if n_several:  # a stand-in is no id: the smallest true id names the component
        true = component.join(stand_in.select(F.col("node").alias("id")), "id", "left_anti")
        least = true.groupBy("component").agg(F.min("id").alias("least"))
        component = component.join(least, "component").select("id", F.col("least").alias("component"))
    named = classes.select("set_key", "rep")
    named = named.join(component.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("set_key", F.coalesce("component", "rep").alias("component"))
    return sig.join(named, "set_key", "left").select(
        "id",
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == F.coalesce("component", "id"))).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", scratch: Scratch | None = None, **options) -> DataFrame:
    """The rows of docs whose id is kept in some row, each text of an id once: one document of each group stays."""
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    result = near_duplicates(docs, id_col, scratch=scratch, **options)
    marks = result.where("id is not null").groupBy("id").agg(F.max("kept").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    marks = scratch.table(marks.select(F.col("id").alias("__id"), "stays"), "marks")
    n, again = marks.count(), marks.where("stays").limit(1).count()
    rows = docs.join(sized(marks, n), F.col(id_col).cast("long") == F.col("__id"), "left")
    once = rows.where("__id is null").drop("__id", "stays")
    if not again:
        return once
    text_col = options.get("text_col", "text")
    return once.union(rows.where("stays").drop("__id", "stays").dropDuplicates([id_col, text_col]))
