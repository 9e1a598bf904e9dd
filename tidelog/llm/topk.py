"""Exact top-k by inner product, with the three phases of the uniform threshold.

The dimensions are split into m lists; a vector's score for a query is the sum
of its partial scores over the lists.  Rows come in tiles, each of which holds
its part of all m lists, and queries in blocks; a task takes one block over one
tile (Cao and Wang's TPUT, 2004, with the lists of a tile on one machine).

1. Each tile finds the k best of each of its lists for each query, scores these
   few in full and returns the k best scores; the k-th best over all tiles is a cutoff
   that k different rows reach, so it is safe.
2. The cutoff c goes to all tiles.  A row that reaches it has a partial score of
   c / m at least in some list; only those entries are collected.
3. Of the entries collected, those whose upper bound (known partial scores and
   c / m for each unknown one) reaches c are scored in full; of these a tile
   returns the k best for each query by score and id, and the k best of all
   tiles are the result.

Integer components make scores exact: in doubles while sums stay under 2**53,
else in 64-bit integers.

Null vectors, empty ones, or ones with null or non-finite components, take no
part, nor do rows with a null id.  Ties go to the smaller id.  A query never
meets rows of its own id.  Vectors of other lengths than the query's don't meet
it.  Repeated rows count each; of several query rows with one id the
smallest vector asks.  Components whose scaled value leaves 64 bits are not
supported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, sized

TILE, BLOCK = 4096, 256


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, d, q): q the integers floor(scale * x) of each usable vector."""
    v = F.col(vector_col).cast("array<double>")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull()).where(F.coalesce(usable, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("d"), F.transform(v, lambda x: F.floor(x * scale)).alias("q"))


def blocked(rows: DataFrame, size: int) -> DataFrame:
    """(d, block, members): rows of one length in blocks of about `size`, dealt by a hash of the id."""
    counts = rows.groupBy("d").agg(F.count("*").alias("n"))
    dealt = rows.join(sized(counts, counts.count()), "d")
    block = F.pmod(F.xxhash64("id", F.lit(size)), F.ceil(F.col("n") / size)).cast("int")
    return dealt.withColumn("block", block).repartition("d", "block").groupBy("d", "block").agg(F.collect_list(F.struct("id", "q")).alias("members"))


def _matrix(members) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(members.field("id"))
    flat = np.asarray(members.field("q").flatten())
    return ids, flat.reshape(len(ids), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _pairwise(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Full scores of the pairs (i, j)."""
    score = np.empty(len(i), np.int64)
    for at in range(0, len(i), 65536):
        at = slice(at, at + 65536)
        score[at] = (q[i[at]] * c[j[at]]).sum(axis=1)
    return score


def _lists(d: int, m: int) -> list[slice]:
    cuts = np.linspace(0, d, min(m, d) + 1).astype(int)
    return [slice(i, j) for i, j in zip(cuts, cuts[1:])]


LEAST = np.iinfo(np.int64).min // 4


def local_lists(k: int, m: int):
    """Phase 1: (query, scores): the k best full scores among the k best of each list in one tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                qid, q = _matrix(batch.column(0)[row].values)
                cid, c = _matrix(batch.column(1)[row].values)
                own = qid[:, None] == cid[None, :]
                seen = np.zeros(own.shape, bool)
                for part in _lists(q.shape[1], m):
                    scores = _products(q[:, part], c[:, part])
                    scores[own] = LEAST
                    best = np.argpartition(-scores, min(k, len(cid)) - 1, axis=1)[:, :k]
                    np.put_along_axis(seen, best, True, axis=1)
                i, j = np.nonzero(seen & ~own)
                score = _pairwise(q, c, i, j)
                order = np.lexsort((-score, i))
                i, score = i[order], score[order]
                first = np.searchsorted(i, np.arange(len(qid) + 1))
                top = [score[a : min(a + k, b)] for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(top, pa.list_(pa.int64()))], ["query", "scores"])

    return run


def collected(k: int, m: int):
    """Phases 2 and 3 in one tile: (query, id, score) of rows that reach the query's cutoff, k at most for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                qid, q = _matrix(batch.column(0)[row].values)
                cid, c = _matrix(batch.column(1)[row].values)
                known = {x["id"]: x["cutoff"] for x in batch.column(2)[row].as_py() or []}
                cut = np.array([known.get(i) if known.get(i) is not None else LEAST for i in qid.tolist()], np.int64)
                lists = _lists(q.shape[1], m)
                share = -(-cut // len(lists))  # rounded up: partial scores are integers
                bound = np.zeros((len(qid), len(cid)))  # in doubles, with room for their rounding
                entered = np.zeros(bound.shape, bool)
                for part in lists:
                    scores = _products(q[:, part], c[:, part])
                    sent = scores >= share[:, None]
                    entered |= sent
                    bound += np.where(sent, scores, share[:, None] - 1)
                entered &= (bound >= cut[:, None] - np.abs(cut[:, None]) * 1e-12 - 1) & (qid[:, None] != cid[None, :])
                i, j = np.nonzero(entered)
                score = _pairwise(q, c, i, j)
                good = score >= cut[i]
                i, j, score = i[good], j[good], score[good]
                order = np.lexsort((cid[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
                keep = place < k
                yield pa.RecordBatch.from_arrays([pa.array(qid[i[keep]]), pa.array(cid[j[keep]]), pa.array(score[keep])], ["query", "id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, lists: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, id, score: the k best rows for each distinct query id; is_query: a condition on `id`."""
    scratch = scratch or Scratch(vectors.sparkSession, "topk")
    rows = scratch.table(quantised(vectors, id_col, vector_col, scale), "integers")
    tiles = scratch.table(blocked(rows, tile).select("d", F.col("block").alias("tile"), F.col("members").alias("c")), "tiles")
    queries = scratch.table(blocked(rows.where(is_query).groupBy("id").agg(F.min(F.struct("d", "q")).alias("v")).select("id", "v.d", "v.q"), block).select("d", "block", F.col("members").alias("q")), "queries")
    # The stated query set against all rows, a block of queries and a tile of rows at a time.
    # Pairs of keys come first; the vectors are fetched by (d, block), then by (d, tile), so that no key has all rows.
    numbers = tiles.groupBy("d").agg(F.max("tile").alias("last"))
    pairs = queries.select("d", "block").join(sized(numbers, numbers.count()), "d")
    pairs = pairs.select("d", "block", F.explode(F.sequence(F.lit(0), "last")).alias("tile"))
    meet = lambda asked: pairs.join(asked, ["d", "block"]).join(tiles, ["d", "tile"])
    work = meet(queries).repartition("d", "block", "tile")
    firsts = work.select("q", "c").mapInArrow(local_lists(k, lists), "query long, scores array<bigint>")
    cutoffs = scratch.table(
        firsts.select("query", F.explode("scores").alias("score"))
        .withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"))))
        .where(F.col("place") == k)
        .select(F.col("query").alias("id"), F.col("score").alias("cutoff")),
        "cutoffs",
    )
    told = (
        queries.select("d", "block", F.explode("q.id").alias("id"))
        .join(cutoffs, "id")
        .groupBy("d", "block")
        .agg(F.collect_list(F.struct("id", "cutoff")).alias("cutoffs"))
    )
    work = meet(queries.join(told, ["d", "block"], "left")).repartition("d", "block", "tile")
    found = work.select("q", "c", "cutoffs").mapInArrow(collected(k, lists), "query long, id long, score long")
    best = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(F.col("query").alias("query_id"), "rank", "id", "score")
    )
