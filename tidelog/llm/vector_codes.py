"""Vector codes: product quantisation with integer codebooks that are broadcast each round.

Each component x becomes the integer floor(scale * x), and a vector is cut into
`parts` consecutive parts, equal where its length divides.  A part position has
a codebook of at most `entries` entries, which start as that part of the
vectors with the smallest ids.  A round assigns every part to the nearest entry
and replaces each entry by the componentwise floor of its parts' mean; an
unused entry stays.  Last, parts are assigned once more.

Codebooks are plain arrays in the task closure: parts x entries x length of a
part integers, whatever the number of vectors.  An Arrow batch works out all squared
distances as |x|^2 - 2 x.c + |c|^2 with 64-bit integer matrix products, so they
are exact, and takes the first smallest.  A task adds up its parts for each entry
and sends one row for each entry and place; a grouped shuffle merges these, and
only the merged sums, as many as a codebook has integers, reach the driver.

Rows whose vector is null or holds null or non-finite components are left out.
Vectors of other lengths have codebooks of their own; an empty vector has empty
parts and the error 0.  Rows with a null id are encoded and come last in the
order of ids; of rows with one id the smallest vector comes first.  With fewer than `entries`
vectors the codebooks are as short.  Repeated rows count each.  Null labels are
equal to each other.  Extra columns are left out, whatever their names.  An
empty table gives no rows.  Components that reach 2**26 after scaling could leave
64 bits in an error and are refused with a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, ready, sized

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Scaled components from here on could overflow an error of 64 bits.
LIMIT = 2**26
#: Rows whose distances are worked out at a time.
BLOCK = 8192

#: The codebooks of one vector length: an (entries, width) array of int64 for each part position.
Codebook = list[np.ndarray]


def cuts(d: int, parts: int) -> list[slice]:
    return [slice(i * d // parts, (i + 1) * d // parts) for i in range(parts)]


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, vec, label) of the rows that are encoded; vec holds doubles."""
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col).cast("string")
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"), label.alias("label"))


def _blocks(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integers) of the vectors of one length, at most BLOCK at a time."""
    sizes = column.value_lengths().to_numpy()
    for d in np.unique(sizes):
        at = np.nonzero(sizes == d)[0]
        for k in range(0, len(at), BLOCK):
            own = at[k : k + BLOCK]
            x = np.floor(np.asarray(column.take(pa.array(own)).flatten(), np.float64) * scale).reshape(len(own), d)
            if x.size and np.abs(x).max() >= LIMIT:
                raise ValueError(f"a component reaches {LIMIT} after scaling by {scale}")
            yield own, x.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first nearest entry and its squared distance, exactly."""
    rest = (book * book).sum(axis=1)[None, :] - 2 * (x @ book.T)  # |x|^2 is the same for all entries
    best = rest.argmin(axis=1)
    return best, rest[np.arange(len(x)), best] + (x * x).sum(axis=1)


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: float = SCALE) -> dict[int, Codebook]:
    """The parts of the vectors with the smallest ids, for each vector length."""
    order = W.partitionBy(F.size("vec")).orderBy(F.col("id").asc_nulls_last(), "vec")
    first = rows.select("id", "vec", F.row_number().over(order).alias("n")).where(F.col("n") <= entries)  # cut before the shuffle too
    books: dict[int, Codebook] = {}
    found = first.orderBy("n").select("vec").toArrow()  # `entries` rows for each length
    for column in found.column(0).chunks:
        for _, x in _blocks(column, scale):
            old = books.get(x.shape[1])
            new = [x[:, c] for c in cuts(x.shape[1], parts)]
            books[x.shape[1]] = new if old is None else [np.concatenate(pair) for pair in zip(old, new)]
    return books


def sums(rows: DataFrame, books: dict[int, Codebook], scale: float = SCALE) -> DataFrame:
    """(d, part, entry, place, total, n): the parts nearest to each entry, added up; a place for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: [np.zeros_like(b) for b in book] for d, book in books.items()}
        n = {d: [np.zeros(len(b), np.int64) for b in book] for d, book in books.items()}
        for batch in batches:
            for _, x in _blocks(batch.column(0), scale):
                d = x.shape[1]
                for p, (c, book) in enumerate(zip(cuts(d, len(books[d])), books[d])):
                    best, _ = nearest(x[:, c], book)
                    order = np.argsort(best, kind="stable")
                    heads = np.nonzero(np.append(True, np.diff(best[order]) > 0))[0]
                    used = best[order][heads]
                    total[d][p][used] += np.add.reduceat(x[order, c], heads, axis=0)
                    n[d][p] += np.bincount(best, minlength=len(book))
        for d, own in total.items():
            for p, t in enumerate(own):
                entry, place = (a.reshape(-1) for a in np.indices(t.shape))
                used = n[d][p][entry] > 0
                entry, place = entry[used].astype(np.int32), place[used].astype(np.int32)
                same = [pa.array(np.full(len(entry), v, np.int32)) for v in (d, p)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(entry), pa.array(place), pa.array(t[entry, place]), pa.array(n[d][p][entry])], ["d", "part", "entry", "place", "total", "n"])

    found = rows.select("vec").mapInArrow(run, "d int, part int, entry int, place int, total long, n long")
    return found.groupBy("d", "part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> dict[int, Codebook]:
    """vector length -> final codebooks.  rows: those of usable()."""
    books = first_codebooks(rows, parts, entries, scale)
    for _ in range(rounds if books else 0):
        merged = sums(rows, books, scale).toPandas()  # as many rows as the codebooks have integers
        books = {d: [b.copy() for b in book] for d, book in books.items()}
        for (d, part), own in merged.groupby(["d", "part"]):
            books[int(d)][int(part)][own["entry"], own["place"]] = own["total"].to_numpy() // own["n"].to_numpy()
    return books


def encoded(rows: DataFrame, books: dict[int, Codebook], scale: float = SCALE) -> DataFrame:
    """rows' id and label with d, code (bytes, one for each part) and error (squared distances added up)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            width, code, error = np.zeros(n, np.int32), [b""] * n, np.zeros(n, np.int64)
            for at, x in _blocks(batch.column(1), scale):
                d = x.shape[1]
                chosen = [nearest(x[:, c], book) for c, book in zip(cuts(d, len(books[d])), books[d])]
                width[at], error[at] = d, sum(e for _, e in chosen)
                for i, row in zip(at.tolist(), np.stack([b for b, _ in chosen], axis=1).astype(np.uint8)):
                    code[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(width), pa.array(code, pa.binary()), pa.array(error)], ["id", "label", "d", "code", "error"])

    return rows.mapInArrow(run, "id long, label string, d int, code binary, error long")


def decoded(codes: DataFrame, books: dict[int, Codebook], scale: float = SCALE) -> DataFrame:
    """codes with `vector`: the doubles that the entries named by a code stand for, the middle of each integer's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, code = batch.column("d").to_pylist(), batch.column("code").to_pylist()
            out = [np.concatenate([b[k] for b, k in zip(books[n], c)]).astype(np.float64) for n, c in zip(d, code)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([(x + 0.5) / scale for x in out], pa.list_(pa.float64()))], [*batch.schema.names, "vector"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(run, f"{fields}, vector array<double>")


def digest(book: Codebook) -> str:
    """SHA-256 of a length's integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in book for v in b.reshape(-1).tolist()).encode()).hexdigest()


def digests(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, scratch: Scratch | None = None) -> DataFrame:
    """id, code (hex), error, label_error (errors added up over equal labels), codebooks_sha256; entries up to 256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: entries from 1 to 256")
    spark = ready(vectors.sparkSession)
    scratch = scratch or Scratch(spark, "vector-codes")
    rows = usable(vectors, id_col, vector_col, label_col)
    books = trained(rows, parts, entries, rounds, scale)
    codes = scratch.table(encoded(rows, books, scale), "codes")
    by_label = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    by_label = sized(by_label, codes.agg(F.approx_count_distinct("label")).first()[0] * 2)
    shas = spark.createDataFrame([(d, digest(b)) for d, b in books.items()], "d int, codebooks_sha256 string")
    found = codes.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).join(F.broadcast(shas), "d")
    return found.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def digests_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 256) -> str:
    """The same rows in DuckDB SQL, for vectors of one length that the parts divide."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    a{r} AS (SELECT id, part, v, arg_min(entry, struct_pack(d := d, e := entry)) AS entry, min(d) AS d FROM
        (SELECT x.id, x.part, x.v, c.entry, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN c{r} c ON c.part = x.part)
        GROUP BY id, part, v)""")
        if r < rounds:
            steps.append(f"""
    m{r} AS (SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY place) AS v FROM
        (SELECT part, entry, place, sum(v[place])::DOUBLE AS s, count(*) AS n FROM a{r}, range(1, len(v) + 1) AS t(place) GROUP BY part, entry, place) GROUP BY part, entry),
    c{r + 1} AS (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry)""")
    return f"""
    WITH kept AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL
        AND list_aggregate(list_transform(embedding, lambda x: coalesce(isfinite(x), false)::INT), 'min') = 1),
    x AS (SELECT id, part, q[part * len(q) // {parts} + 1 : (part + 1) * len(q) // {parts}] AS v FROM kept, range(0, {parts}) AS t(part)),
    starts AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM kept),
    c0 AS (SELECT part, entry, v FROM x JOIN starts USING (id) WHERE entry < {entries}),{",".join(steps)},
    sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
    codes AS (SELECT id, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id)
    SELECT id AS vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (id), sha
    """
