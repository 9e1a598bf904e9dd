"""A corpus from raw documents to token ids: five stages over the operators of tidelog.llm.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  A stage's first act is to delete the scratch tables of stages
before it, whose results are written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, minhash, mixing, quality_mil, substring
from tidelog.llm.common import Scratch, ready, table

#: near duplicates: shingles of five words at a similarity of 0.80; repeated passages: 50 words and more.
SHINGLE_WORDS, PERCENT, PASSAGE_WORDS, SEED = 5, 80, 50, 17


_open: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """A stage's scratch tables; those of the stages before it go."""
    while _open:
        _open.pop().close()
    _open.append(Scratch(spark, name))
    return _open[-1]


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    _scratch(spark, "quality")
    judged = quality_mil.judged(docs, table(ready(spark), sf_dir, "labels"))
    return judged.where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    scratch = _scratch(spark, "minhash")
    return minhash.without_near_duplicates(docs, scratch=scratch, k=SHINGLE_WORDS, percent=PERCENT, bands=30, rows=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has."""
    scratch = _scratch(spark, "substring")
    return _sized(substring.deduplicated(docs, window=PASSAGE_WORDS, scratch=scratch)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to bring the sources to their target weights."""
    _scratch(spark, "mixing")
    return mixing.mixed(docs, seed=SEED).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens."""
    import public_tokenizers

    _scratch(spark, "bpe")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encoded(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN)
    return rows.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality_mil", quality),
    ("minhash", near_duplicates),
    ("substring", repeated_passages),
    ("mixing", mix),
    ("bpe", encode),
]

#: The learned classifier and the tokenizer's merges have no SQL form; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    written = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        path = written.path(name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
