"""A stored full-text index: postings with places, read by the terms of a question.

`build` cuts and stems every text once.  Postings (term, id, dl, tf, places) lie
in folders by a hash of the term; within a folder, files by a hash of the id,
sorted by term, so that a question opens its terms' folders and skips all other
row groups by their statistics.  How many folders and files there are follows
from the bytes and rows counted.  Names that texts hold lie beside them, sorted
by name.  Statistics are one row.

`stored` builds an index once for a table as it is: the folder's name is a hash
of the table's files, their lengths and times.

A question costs its terms' postings, summed up by id, and nothing reads a text.
How many texts have a term is stored; for phrases it is counted.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import stems
from tidelog.sources.tables import exists, file_marks, rename, workers_import

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Bytes of text and rows for each file of postings; folders at least.
FILE_BYTES, FILE_ROWS, LEAST_PARTS = 256 << 20, 50_000_000, 16
#: Changes with what `build` writes, so that an older index isn't taken for one of today.
FORMAT = 2
#: Tokens that a batch of postings has before it is passed on.
BATCH = 2_000_000
#: A name in a text: up to three words in a row that begin with a capital.
NAME = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,2}"


def weight(tf, df, n, dl, avg) -> Column:
    """The part of one phrase in a text's BM25 score."""
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg))


def terms(text: Column) -> Column:
    """The stems of a text's words, in order."""

    @F.pandas_udf("array<string>")
    def run(texts):
        return texts.map(lambda t: stems.terms(t) if t else [])

    return run(F.coalesce(text, F.lit("")))


def postings(rows: DataFrame) -> DataFrame:
    """(term, id, dl, tf, places) of rows (id, text): a row for each stem of a text; places count words from 0."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["term", "id", "dl", "tf", "places"]

    def table(ids: pa.Array, rows_of: list[int], sizes: list[int], codes: list[int], known: list[str]) -> pa.RecordBatch:
        """Tokens in order, as (row, place, code), sorted by row and code: a run of equal ones is a posting."""
        dl, code = np.array(sizes, np.int64), np.array(codes, np.int64)
        at = np.repeat(np.arange(len(dl)), dl)
        place = np.arange(len(code)) - (np.cumsum(dl) - dl)[at]
        order = np.argsort(at * len(known) + code, kind="stable")
        at, code, place = at[order], code[order], place[order].astype(np.int32)
        heads = np.nonzero(np.append(True, (at[1:] != at[:-1]) | (code[1:] != code[:-1])))[0]
        ends = np.append(heads, len(code)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(place))
        columns = [pa.array(known, pa.string()).take(pa.array(code[heads])), ids.take(pa.array(np.array(rows_of)[at[heads]])), pa.array(dl[at[heads]].astype(np.int32)), pa.array(np.diff(ends)), lists]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = stems.Numbers()
            rows_of, sizes, codes = [], [], []
            for i, text in enumerate(batch.column(1)):
                words = stems.words(text.as_py() or "")
                if words:
                    rows_of.append(i)
                    sizes.append(len(words))
                    codes.extend(map(numbers.__getitem__, words))
                if len(codes) >= BATCH:
                    yield table(batch.column(0), rows_of, sizes, codes, list(numbers.stems))
                    rows_of, sizes, codes = [], [], []
            if codes:
                yield table(batch.column(0), rows_of, sizes, codes, list(numbers.stems))

    workers_import(rows.sparkSession)
    return rows.select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"term string, id {kind}, dl int, tf int, places array<int>")


def _read(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(f"term string, id {kind}, dl int, tf int, places array<int>, part int").parquet(f"{folder}/postings")


def part_of(term: str, parts: int) -> int:
    return zlib.crc32(term.encode()) % parts


def build(rows: DataFrame, folder: str) -> None:
    """The index of rows (id, text) in a new folder."""
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows = rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)  # a file of one row group is one task else
    files = max(LEAST_PARTS, -(-(size or 0) // FILE_BYTES))
    salts = max(1, -(-n // FILE_ROWS))
    parts = max(LEAST_PARTS, files // salts)
    part = (F.crc32(F.col("term").cast("binary")) % parts).cast("int")
    dealt = postings(rows).withColumn("part", part).repartition("part", F.pmod(F.xxhash64("id"), F.lit(salts)))
    dealt.sortWithinPartitions("part", "term", "id").write.partitionBy("part").parquet(f"{folder}/postings")
    written = _read(rows.sparkSession, folder, rows.schema["id"].dataType.simpleString())
    written.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    total = written.agg(F.sum("tf").alias("tokens"))
    named = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))).alias("name"))
    named.repartitionByRange("name").sortWithinPartitions("name", "id").write.parquet(f"{folder}/names")
    whole = total.select(F.lit(n).alias("n"), (F.coalesce("tokens", F.lit(0)) / F.lit(max(n, 1))).alias("avg"), F.lit(parts).alias("parts"))
    whole.coalesce(1).write.parquet(f"{folder}/corpus")  # last: its presence says that the index is whole


def stored(rows: DataFrame, root: str) -> TextIndex:
    """The index of rows (id, text) that are read from files, built where it isn't yet."""
    spark = rows.sparkSession
    mark = hashlib.sha256("\n".join([f"format {FORMAT}", *file_marks(spark, rows.inputFiles()), str(rows.columns)]).encode()).hexdigest()[:32]
    folder = f"{root}/text-index-{mark}"
    if not exists(spark, f"{folder}/corpus/_SUCCESS"):
        fresh = f"{folder}-{uuid.uuid4().hex}"
        build(rows, fresh)
        rename(spark, fresh, folder)  # of two builders one is first; both are right
        if not exists(spark, f"{folder}/corpus/_SUCCESS"):
            folder = fresh
    return TextIndex(spark, folder)


class TextIndex:
    """Questions to a built index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.corpus = spark.read.parquet(f"{folder}/corpus")
        self.parts = self.corpus.first()["parts"]

    def postings(self, wanted: list[str], places: bool) -> DataFrame:
        own = sorted({part_of(t, self.parts) for t in wanted})
        kind = self.spark.read.parquet(f"{self.folder}/names").schema["id"].dataType.simpleString()
        rows = _read(self.spark, self.folder, kind).where(F.col("part").isin(own) & F.col("term").isin(wanted))
        return rows.select("term", "id", "dl", "tf", *(["places"] if places else []))

    def hits(self, phrases: list[list[str]], every: bool = True, out: str = "score") -> DataFrame:
        """(id, score) of the texts that have all (or, with every=False, any) of the phrases, best higher."""
        wanted = [tuple(found) for p in phrases if (found := stems.terms(" ".join(p)))]
        single = list(dict.fromkeys(t for p in wanted for t in p))
        found = self.postings(single, any(len(p) > 1 for p in wanted))
        if not wanted:
            return found.select("id", F.lit(0.0).alias(out)).where(F.lit(False))
        of = lambda t, c: F.max(F.when(F.col("term") == t, F.col(c)))
        needs = [F.coalesce(of(p[0], "tf"), F.lit(0)).alias(f"c{i}") for i, p in enumerate(wanted) if len(p) == 1]
        needs += [of(t, "places").alias(f"p{i}_{j}") for i, p in enumerate(wanted) if len(p) > 1 for j, t in enumerate(p)]
        by_id = found.groupBy("id").agg(F.max("dl").alias("dl"), *needs)

        def times(i: int, phrase: tuple) -> Column:
            if len(phrase) == 1:
                return F.col(f"c{i}")
            starts = F.col(f"p{i}_0")
            for j in range(1, len(phrase)):
                back = lambda x: (x - j).cast("int")  # noqa: B023, E731
                starts = F.array_intersect(starts, F.transform(f"p{i}_{j}", back))
            return F.coalesce(F.size(starts), F.lit(0))

        tf = by_id.select("id", "dl", *[F.greatest(times(i, p), F.lit(0)).alias(f"t{i}") for i, p in enumerate(wanted)])
        if all(len(p) == 1 for p in wanted):
            known = self.spark.read.parquet(f"{self.folder}/terms").where(F.col("term").isin(single))  # a row for each term
            frequency = known.agg(*[F.coalesce(of(p[0], "df"), F.lit(0)).alias(f"d{i}") for i, p in enumerate(wanted)])
        else:  # one row as well; with dl its sums by id are those of tf, so Spark makes them once
            frequency = tf.agg(*[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(wanted))], F.max("dl").alias("longest")).drop("longest")
        rows = tf.join(F.broadcast(frequency)).join(F.broadcast(self.corpus.select("n", "avg")))
        keep, score = F.lit(every), F.lit(0.0)
        for i in range(len(wanted)):
            has = F.col(f"t{i}") > 0
            keep = (keep & has) if every else (keep | has)
            score = score + weight(F.col(f"t{i}"), F.col(f"d{i}"), F.col("n"), F.col("dl"), F.col("avg"))
        return rows.where(keep).select("id", score.alias(out))

    def named(self, names: list[str]) -> DataFrame:
        """(id, mentions): how many of the names each text holds."""
        rows = self.spark.read.parquet(f"{self.folder}/names").where(F.col("name").isin(names))
        return rows.groupBy("id").agg(F.count("*").alias("mentions"))
