"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source that holds b of B bytes and has weight w gets the mean repetition rate
w * B / b.  A document is repeated k times, where k inverts the Poisson
distribution of that mean at a number from 0 to 1 drawn by hashing the seed and
the id: the outcome is the same on every run and however the rows are
partitioned.  Copies are then shuffled globally by a hash of id and copy.

A mean above PART is split into equal parts of at most PART, each drawn by a
hash of its own, whose sum has the distribution of the mean, however large.

Null sources form a source of their own.  Null or empty texts count one byte, a
very long text its bytes.  Rows with equal ids draw the same number.  Columns
`n_copies` and `copy_no` of the input are replaced by those of the result; other
extra columns stay.  An empty table gives no rows.  The table of sources is
broadcast only up to BROADCAST_BYTES; beyond it, it is joined by shuffled keys.  Without given weights a source's
weight grows as its bytes to the power `alpha`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch

#: The largest mean of a single draw: exp(-PART) stays a normal double, and arrays of probabilities short.
PART = 256
#: Bytes of the table of sources up to which it is broadcast: a row holds some 100 bytes and a probability for each term.
BROADCAST_BYTES = 32 << 20
#: Parts of a source's rows where the table of sources is too large to be broadcast; copies made at a time.
SALTS, COPIES = 64, 65_536


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, alpha: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """(source, rate): a row for each source."""
    sizes = docs.groupBy(F.col(source_col).alias("__source")).agg(
        F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("double").alias("bytes")
    )
    if weights is None:
        wanted = sizes.withColumn("weight", F.pow("bytes", F.lit(alpha)))
    else:
        known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
        wanted = sizes.withColumn("weight", F.coalesce(F.try_element_at(known, F.coalesce(F.col("__source").cast("string"), F.lit(""))), F.lit(0.0)).cast("double"))
    total = wanted.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_bytes") / F.col("bytes")).otherwise(0.0)
    return wanted.join(F.broadcast(total)).select("__source", (rate * F.lit(float(epochs))).alias("rate"))


def uniform(*parts):
    """52 bits of an MD5 as a double from 0 up to 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate, terms: int):
    """P(X <= j) for j = 0 .. terms as an array, by adding up the terms of the distribution."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        start,
        lambda s, j: F.struct((s["p"] * rate / j).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * rate / j)).alias("cdf")),
        lambda s: s["cdf"],
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, scratch: Scratch | None = None, **weighing) -> DataFrame:
    """Rows of docs, each as often as drawn, with n_copies and copy_no (from 1), in a global hash order."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    table = scratch.table(rates(docs, source_col, text_col, **weighing), "rates")
    n_sources, most = table.agg(F.count("*"), F.max("rate")).first()
    most = min(most or 0, PART)
    terms = math.ceil(most + 12 * math.sqrt(most) + 30)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1))
    table = table.select("__source", parts.alias("__parts"), poisson_cdf(F.col("rate") / parts, terms).alias("__cdf"))
    source = F.col(source_col)
    if n_sources * (100 + 8 * (terms + 1)) <= BROADCAST_BYTES:
        mine = docs.join(F.broadcast(table), source.eqNullSafe(F.col("__source")))
    else:  # a source that holds a third of all rows spreads over SALTS keys
        salted = docs.withColumn("__salt", F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)))
        table = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = salted.join(table, source.eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__part"))).drop("__salt", "__part")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))

    def count(*more):
        drawn = uniform(F.lit(str(seed)), name, *more)
        return F.size(F.filter("__cdf", lambda c: c <= drawn))

    fresh = [c for c in ("n_copies", "copy_no") if c in docs.columns]
    one = mine.withColumn("__u", uniform(F.lit(str(seed)), name)).withColumn("__n", F.size(F.filter("__cdf", lambda c: c <= F.col("__u"))).cast("long"))  # the hash once a row
    more = F.aggregate(F.sequence(F.lit(1), F.col("__parts") - 1), F.lit(0).cast("long"), lambda n, i: n + count(i.cast("string")))
    out = one.withColumn("__n", F.when(F.col("__parts") > 1, F.col("__n") + more).otherwise(F.col("__n"))).where("__n > 0")
    # Two steps, so that no row holds an array of all its copies.
    out = out.withColumn("__step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {COPIES}"))))
    out = out.withColumn("__copy", F.explode(F.sequence(F.col("__step") * COPIES + 1, F.least("__n", (F.col("__step") + 1) * COPIES))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), name, F.col("__copy")))
    out = out.withColumn("__key", key).repartition("__key").sortWithinPartitions("__key")
    out = out.drop("__source", "__cdf", "__parts", "__step", "__u", "__key", *fresh)
    return out.withColumnsRenamed({"__n": "n_copies", "__copy": "copy_no"})


def mixed_sql(seed: int = 17, alpha: float = 0.7) -> str:
    """The same rows in DuckDB SQL."""
    terms = math.ceil(PART + 12 * math.sqrt(PART) + 30)
    return f"""
    WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS bytes FROM documents GROUP BY source),
    weighed AS (SELECT source, bytes, pow(bytes, {alpha}) AS weight FROM sizes),
    whole AS (SELECT source, weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(bytes) FROM weighed) / bytes AS rate FROM weighed),
    rates AS (SELECT source, greatest(ceil(rate / {PART}), 1)::BIGINT AS parts, rate / greatest(ceil(rate / {PART}), 1) AS rate FROM whole),
    terms AS (SELECT source, j, exp(j * ln(rate) - rate - lgamma(j + 1)) AS p FROM rates, range(0, {terms}) AS t(j)),
    cdf AS (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM terms),
    draws AS (SELECT d.*, ('0x' || substr(md5('{seed}|' || doc_id || CASE WHEN i = 0 THEN '' ELSE '|' || i END), 1, 13))::BIGINT / pow(2, 52) AS u
        FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, range(0, r.parts) AS t(i)),
    counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*)::BIGINT AS n_copies
        FROM draws d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= d.u GROUP BY ALL)
    SELECT counted.*, k::BIGINT AS copy_no FROM counted, range(1, n_copies + 1) AS r(k)
    """
