"""Scores of retrieval, abstention, extraction and digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.ranges import before, ranged


def ranked_scores(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: precision, recall and hit at k, reciprocal rank.  hits: (query, rank, id); relevant: (query, id).

    Precision divides by k even if there are fewer hits.
    """
    expected = relevant.groupBy("query").agg(F.countDistinct("id").alias("n"))
    found = hits.join(relevant.select("query", "id").distinct(), ["query", "id"]).groupBy("query")
    found = found.agg(F.count_if(F.col("rank") <= k).alias("in_k"), F.min("rank").alias("first"))
    out = expected.join(found, "query", "left")
    at_k = F.coalesce("in_k", F.lit(0))
    return out.select(
        "query",
        (at_k / k).alias("precision"),
        (at_k / F.col("n")).alias("recall"),
        (at_k > 0).cast("int").alias("hit"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
    )


def summary(cases: DataFrame) -> DataFrame:
    """One row over (answerable, hit, recall, rr, answered): null where nothing could be counted."""
    can = F.col("answerable")
    hit = F.avg(F.when(can, F.col("hit")))
    wrong = F.avg(F.when(~can, F.col("answered").cast("int")))
    return cases.agg(
        F.count_if(can).alias("answerable"), F.count_if(~can).alias("unanswerable"), hit.alias("hit"), F.avg(F.when(can, F.col("recall"))).alias("recall"),
        F.avg(F.when(can, F.col("rr"))).alias("mrr"), wrong.alias("fpr"), (hit - wrong).alias("separation"),
    )


def abstention_threshold(samples: DataFrame, *keys: str) -> DataFrame:
    """The midpoint between neighbouring scores with the best Youden J; of equals the lowest.  samples: (score, positive).

    Counts above each midpoint are running sums over ranges of scores, each
    sorted apart, and of those over whole ranges.
    """
    grouped = samples.where("score is not null").groupBy(*keys, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    rows = before(ranged(grouped, "score", keys), keys, {"pb": F.col("p"), "nb": F.col("n")})
    firsts = rows.groupBy(*keys, "__range").agg(F.min("score").alias("first"))  # RANGES rows a key at most
    firsts = firsts.select(*keys, "__range", F.lead("first").over(W.partitionBy(*keys).orderBy("__range")).alias("after"))
    rows = rows.join(firsts.withColumnsRenamed({k: f"__f_{k}" for k in (*keys, "__range")}), reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"__f_{k}")), (*keys, "__range"), F.lit(True)))
    order = W.partitionBy(*keys, "__range").orderBy("score")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    out = rows.select(
        *keys, "score", F.coalesce(F.lead("score").over(order), F.col("after")).alias("next"), (F.col("pb") + F.sum("p").over(upto)).alias("pb"),
        (F.col("nb") + F.sum("n").over(upto)).alias("nb"), F.col("pb_all").alias("pt"), F.col("nb_all").alias("nt"),
    ).where(F.col("next").isNotNull() & (F.col("pt") > 0) & (F.col("nt") > 0))
    j = (F.col("pt") - F.col("pb")) / F.col("pt") - (F.col("nt") - F.col("nb")) / F.col("nt")
    out = out.select(*keys, ((F.col("score") + F.col("next")) / 2).alias("threshold"), F.round(j, 9).alias("youden"))
    best = out.groupBy(*keys).agg(F.min(F.struct((-F.col("youden")).alias("minus"), "threshold")).alias("b"))
    return best.select(*keys, "b.threshold", (-F.col("b.minus")).alias("youden"))


def gate(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    """(name, value, passed): each metric within its bound (name, least, most); one that is missing fails."""
    inside = (F.col("value") >= F.coalesce("least", "value")) & (F.col("value") <= F.coalesce("most", "value"))
    return bounds.join(metrics, "name", "left").select("name", "value", F.coalesce(inside, F.lit(False)).alias("passed"))


def span_scores(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Per document: exact-match precision, recall and F1 of spans (doc, kind, begin, end); 1 where both are empty."""
    keys = ["doc", "kind", "begin", "end"]
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(found.select(*keys).distinct().withColumn("f", F.lit(1)), keys, "full")
    n = both.groupBy("doc").agg(F.count("g").alias("g"), F.count("f").alias("f"), F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("both"))
    p = F.when(F.col("f") == 0, F.when(F.col("g") == 0, 1.0).otherwise(0.0)).otherwise(F.col("both") / F.col("f"))
    r = F.when(F.col("g") == 0, F.when(F.col("f") == 0, 1.0).otherwise(0.0)).otherwise(F.col("both") / F.col("g"))
    out = n.select("doc", p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def digest_scores(digests: DataFrame, facts: DataFrame, forbidden: list[str], least: int, most: int) -> DataFrame:
    """Per digest (id, text): share of its facts (id, fact) it has, forbidden terms, citations, words, fit of length."""
    low = F.lower("text")
    hit = facts.join(digests, "id").groupBy("id").agg(F.avg(F.lower("text").contains(F.lower("fact")).cast("int")).alias("coverage"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    bad = sum((F.when(low.contains(t.lower()), 1).otherwise(0) for t in forbidden), F.lit(0))
    rows = digests.select("id", bad.alias("forbidden"), F.size(F.regexp_extract_all("text", F.lit(r"\[event:[0-9]+\]"), F.lit(0))).alias("citations"), words.alias("words"), words.between(least, most).alias("fits"))
    return rows.join(hit, "id", "left")
