"""The questions clients ask, one function each; every answer is a DataFrame.

A Brain names the tables that answers come from.  Times are microseconds; `now`
is always given, never the clock's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.urls import search_query, source_quality
from tidelog.operators import claims as claim_store
from tidelog.operators import evidence, extract, search, store, timeline, usermodel
from tidelog.operators.textindex import TextIndex

#: The most rows an answer may have.
LIMIT = 200


@dataclass(frozen=True)
class Brain:
    """moments: id, ts_us, app, device, title, url, text; vectors: id, embedding; mentions: id, name; the claim tables.

    index: the stored index of the moments' texts; without one they are scanned.
    identities: (identity, name), the names of each.
    """

    moments: DataFrame
    vectors: DataFrame | None = None
    mentions: DataFrame | None = None
    claims: DataFrame | None = None
    transitions: DataFrame | None = None
    propositions: DataFrame | None = None
    index: TextIndex | None = None
    identities: DataFrame | None = None


def names_in(brain: Brain, text: str) -> DataFrame:
    """(name): what a question may name, and the other names of the same identities."""
    named = brain.mentions.sparkSession.createDataFrame([(n,) for n in search.capitalised(text)], "name string")
    addresses = extract.mentions(brain.mentions.sparkSession.createDataFrame([(1, text)], "id long, text string"), "id")
    named = named.union(addresses.where("kind <> 'redacted_token'").select("name")).distinct()
    if brain.identities is None:
        return named
    own = brain.identities.join(F.broadcast(named), "name", "left_semi").select("identity")  # of the question's few names
    return named.union(brain.identities.join(F.broadcast(own.distinct()), "identity", "left_semi").select("name")).distinct()


def recall(brain: Brain, text: str, now: int, vector: list[float] | None = None, names: list[str] | None = None, limit: int = 10, verdict: str | None = None, **filters) -> DataFrame:
    """The moments that answer a question best, with `outcome`.

    Without a vector the answer is lexical and degraded.  A phrase of time
    narrows the range; a question for what was next to something looks about
    the best vector hit.  Names come from the question, or as given, and bring
    the other names of their identities.  Where the texts found lack the kind of answer that the
    question asks for, nothing matches; else a verifier's verdict decides, and
    without a qualified one the answer is degraded, and still ranked.
    """
    limit = min(limit, LIMIT)
    way = search.route(text, now)
    start, end = search.intersection((filters.pop("start", None), filters.pop("end", None)), (way.start, way.end))
    rows = store.matching(brain.moments, start, end, **filters)
    near = None
    if vector is not None and brain.vectors is not None:
        vectors = brain.vectors.join(rows.select("id"), "id", "left_semi")
        near = search.best(search.vector_scores(vectors, vector), search.POOL).select("id", "score")
        if way.shape == "anchor":
            at = rows.join(F.broadcast(near.orderBy(F.desc("score"), "id").limit(1).select("id")), "id").select(F.col("ts_us").alias("__at"))  # one row
            span = 5 * timeline.MINUTE
            rows = rows.join(F.broadcast(at)).where(F.col("ts_us").between(F.col("__at") - span, F.col("__at") + span)).drop("__at")
            near = near.join(rows.select("id"), "id", "left_semi")
    if brain.index is None:
        found = search.relaxed(rows, text).select("id", "score")
    else:
        found = search.relaxed_hits(brain.index, text).select("id", "score").join(rows.select("id"), "id", "left_semi")
    found = search.best(found, search.POOL)
    if near is None:
        return found.orderBy(F.desc("score"), "id").limit(limit).withColumn("outcome", F.lit("degraded: no embeddings"))
    pool = search.pooled(near, found)
    own = rows.join(F.broadcast(pool), "id")
    named = F.col("app").isNotNull() | F.col("title").isNotNull()
    facts = own.select("id", "rr_semantic", "rr_lexical", search.recency(F.col("ts_us"), now).alias("recency"), source_quality(F.col("url"), named).alias("source"))
    if brain.mentions is not None:
        wanted = names_in(brain, text) if names is None else brain.mentions.sparkSession.createDataFrame([(n,) for n in names], "name string")
        hit = brain.mentions.join(F.broadcast(pool.select("id")), "id", "left_semi").join(wanted, "name", "left_semi")
        facts = facts.join(hit.groupBy("id").agg(F.count("*").alias("mentions")), "id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    else:
        facts = facts.withColumn("mentions", F.lit(0))
    pairs = own.select("id", "text").join(near.withColumnRenamed("score", "cosine"), "id", "left").select("id", "text", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.lit(text).alias("asked"))
    signal = evidence.explicit_relations(pairs, question="asked")  # one row, as is that of the features
    score = evidence.features(pairs, question="asked").select(evidence.sufficiency({c: F.col(c) for c in evidence.FEATURES}).alias("sufficiency"))
    judged = evidence.outcome(F.lit(1), F.lit(True), F.col("signal"), F.col("superseding"), F.lit(verdict).cast("string"), F.col("sufficiency"))
    one = signal.join(F.broadcast(score)).select(judged.alias("outcome")).where("outcome <> 'nothing_matched'")
    return search.ranked(facts, limit).join(F.broadcast(one)).orderBy(F.desc("score"), "id")


def events_since(brain: Brain, ts_us: int, limit: int = 50) -> DataFrame:
    return store.since(brain.moments, ts_us, min(limit, LIMIT), "text")


def events_by_app(brain: Brain, app: str, limit: int = 50) -> DataFrame:
    return store.by_app(brain.moments, app, min(limit, LIMIT))


def stats(brain: Brain) -> DataFrame:
    return brain.moments.agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.countDistinct("app").alias("apps"))


def episodes(brain: Brain, limit: int = 50) -> DataFrame:
    rows = timeline.episodes(brain.moments)
    grouped = rows.groupBy("device", "episode", "app").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n"))
    return grouped.orderBy(F.desc("end_us"), "device", "episode").limit(min(limit, LIMIT))


def sessions(brain: Brain, start: int, end: int) -> DataFrame:
    rows = timeline.sessions(store.in_range(brain.moments, start, end))
    return rows.groupBy("device", "session").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n"))


def day(brain: Brain, start: int) -> DataFrame:
    """Time of each application in the day that begins at `start`."""
    return timeline.day_breakdown(brain.moments.where((F.col("ts_us") >= start) & (F.col("ts_us") < start + timeline.DAY)))


def searches(brain: Brain, limit: int = 50) -> DataFrame:
    """Searches that addresses hold, newest first, repeats within a minute dropped."""
    found = brain.moments.withColumn("s", search_query(F.col("url"))).where(F.col("s").isNotNull())
    rows = found.select("id", "ts_us", F.col("s.engine").alias("engine"), F.col("s.query").alias("query"))
    return store.newest(timeline.collapsed_repeats(rows, "engine", "query"), min(limit, LIMIT))


def context(brain: Brain, now: int, tokens: int = 1200) -> DataFrame:
    """Claims that hold now, without conflicts, as many as fit."""
    active = claim_store.active_as_of(brain.claims, brain.transitions, now, now)
    kept, _ = claim_store.conflicts(active)
    words = F.size(F.split(F.concat_ws(" ", "subject", "predicate", "object"), r"\s+"))
    return claim_store.packet(kept.withColumn("n_tokens", words), LIMIT, tokens)


def person(brain: Brain, n: int = 6) -> DataFrame:
    """What is known of each subject, most certain first."""
    return usermodel.servable(brain.propositions, "subject", n)
