"""A bitemporal store of claims: what held at one time, as known at another.

claims: id, subject, predicate, object, scope, valid_from, valid_to (null: open),
asserted, status, confidence.  transitions: id, claim, effective, asserted,
status.  evidence: claim, event.  All are append-only; a status is always read
from the latest transition by (asserted, effective, id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.sources.tables import workers_import

CONFIDENT = 0.65


def known(claims: DataFrame, valid: int, asserted: int) -> DataFrame:
    """Claims asserted by then and valid then; both ends of the validity belong to it."""
    return claims.where((F.col("asserted") <= asserted) & (F.col("valid_from") <= valid) & (F.coalesce("valid_to", F.lit(valid)) >= valid))


def latest_status(transitions: DataFrame, valid: int, asserted: int) -> DataFrame:
    """(claim, now): the status last recorded by `asserted` and effective by `valid`."""
    seen = transitions.where((F.col("asserted") <= asserted) & (F.col("effective") <= valid))
    return seen.groupBy("claim").agg(F.max(F.struct("asserted", "effective", "id", "status"))["status"].alias("now"))


def status_as_of(claims: DataFrame, transitions: DataFrame, valid: int, asserted: int) -> DataFrame:
    latest = latest_status(transitions, valid, asserted).withColumnRenamed("claim", "id")
    return known(claims, valid, asserted).join(latest, "id", "left").withColumn("status", F.coalesce("now", "status")).drop("now")


def active_as_of(claims: DataFrame, transitions: DataFrame, valid: int, asserted: int) -> DataFrame:
    return status_as_of(claims, transitions, valid, asserted).where(F.col("status") == "active")


def history(claims: DataFrame, transitions: DataFrame) -> DataFrame:
    """(claim, step, asserted, effective, status): the beginning is step 0, then the transitions in order."""
    order = W.partitionBy("claim").orderBy("asserted", "effective", "id", "status")
    later = transitions.select("claim", F.row_number().over(order).alias("step"), "asserted", "effective", "status")
    return claims.select(F.col("id").alias("claim"), F.lit(0).alias("step"), "asserted", F.col("valid_from").alias("effective"), "status").union(later)


def retractions(events: DataFrame, evidence: DataFrame, asserted: int) -> DataFrame:
    """A `retracted` transition for every claim with evidence from one of the events."""
    hit = evidence.join(events, "event", "left_semi").select("claim").distinct()
    return hit.select("claim", F.lit(asserted).alias("asserted"), F.lit(asserted).alias("effective"), F.lit("retracted").alias("status"))


def supersessions(claims: DataFrame) -> DataFrame:
    """A new active claim retires the one before it of the same subject, predicate and scope, when it begins to hold."""
    order = W.partitionBy("subject", "predicate", "scope").orderBy("valid_from", "id")
    before = claims.where(F.col("status") == "active").withColumn("claim", F.lag("id").over(order))
    return before.where(F.col("claim").isNotNull()).select("claim", F.col("id").alias("by"), F.col("valid_from").alias("effective"))


def conflicts(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): all claims of a subject, predicate and scope go where their objects differ."""
    keys = ["subject", "predicate", "scope"]
    objects = claims.groupBy(*keys).agg(F.countDistinct(F.lower(F.trim("object"))).alias("__n"))
    marked = claims.join(objects, keys)
    return marked.where("__n = 1").drop("__n"), marked.where("__n > 1").drop("__n")


def projected(deltas: DataFrame, stored: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """deltas with `fate`: insert, same (a replay), or conflict (the id with another payload)."""
    old = stored.select(key, F.col(payload).alias("__old"))
    fate = F.when(F.col("__old").isNull(), "insert").when(F.col("__old") == F.col(payload), "same").otherwise("conflict")
    return deltas.join(old, key, "left").withColumn("fate", fate).drop("__old")


def closure(seeds: DataFrame, edges: DataFrame, checkpoint, most: int = 50) -> DataFrame:
    """Ids reachable over directed edges (src, dst) from seeds (id): what a deletion takes with it.

    Each round joins only the newest ids; `checkpoint` cuts their lineage (for
    instance DataFrame.checkpoint).  Raises if `most` rounds don't end it.
    """
    seen = checkpoint(seeds.select("id").distinct())
    new = seen
    for _ in range(most):
        step = new.join(edges, new["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        new = checkpoint(step.join(seen, "id", "left_anti"))
        if new.isEmpty():
            return seen
        seen = checkpoint(seen.union(new))
    raise RuntimeError(f"no fixpoint in {most} rounds")


def section(predicate):
    """The part of a packet that a claim belongs in."""
    p = F.lower(predicate)
    return (
        F.when(p.contains("decision") | p.contains("decided"), "decisions")
        .when(p.contains("open") | p.contains("todo") | p.contains("urgent"), "open loops")
        .when(p.contains("person") | p.contains("people"), "people")
        .otherwise("current state")
    )


def packet(claims: DataFrame, evidence_limit: int, tokens: int, words: str = "n_tokens", keys: tuple[str, ...] = ()) -> DataFrame:
    """Confident claims, best first, that fit a budget of tokens; one that doesn't is passed over, and smaller ones after it still fit.

    Candidates of each of `keys` are first cut to evidence_limit rows; the fold
    then runs over that bounded list.  Adds `used`, the tokens up to a claim.
    """
    best = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    pool = claims.where(F.col("confidence") >= CONFIDENT)
    if not keys:
        pool = pool.orderBy(F.desc("confidence"), "id").limit(evidence_limit)
    pool = pool.withColumn("__place", F.row_number().over(best.orderBy(F.desc("confidence"), "id"))).where(F.col("__place") <= evidence_limit)
    listed = pool.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__place").alias("place"), F.col(words).cast("long").alias("n")))).alias("__all"))
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<place:int,used:bigint>>").alias("kept"))

    def step(a, x):
        taken = F.struct((a["used"] + x["n"]).alias("used"), F.array_append(a["kept"], F.struct(x["place"].alias("place"), (a["used"] + x["n"]).alias("used"))).alias("kept"))
        return F.when(a["used"] + x["n"] <= tokens, taken).otherwise(a)

    kept = listed.select(*keys, F.explode(F.aggregate("__all", state, step, lambda a: a["kept"])).alias("__kept")).select(*keys, F.col("__kept.place").alias("__place"), F.col("__kept.used").alias("used"))
    return pool.join(kept, [*keys, "__place"]).drop("__place")


@dataclass(frozen=True)
class Budget:
    """The most nodes, edges, pieces of evidence and tokens of an expansion."""

    nodes: int
    edges: int
    evidence: int
    tokens: int


EXPANDED = "kind string, node string, place int, n_tokens long, truncated boolean"


def expansion(seeds: DataFrame, evidence: DataFrame, events: DataFrame, mentions: DataFrame, identities: DataFrame, budget: Budget) -> DataFrame:
    """What claims bring along, within a budget: (request, kind, node, place, n_tokens, truncated), in the order of admission.

    seeds: (request, claim); evidence: (claim, id, event); events: (event, text,
    episode); mentions: (event, entity); identities: (entity, identity).  Claims
    with evidence that fits at all come first, then by id; of a claim its
    evidence by id, each with its episode, entities and identities.  What doesn't
    fit is passed over and marks the request truncated (a last row of kind
    `end`); smaller things after it are still taken.  A claim costs a node,
    evidence an edge and its words, any other node both.  Rows of a request
    stream by in this order; what is held is what the budget admits.
    """
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    linked = mentions.join(identities, "entity", "left").groupBy("event").agg(F.array_sort(F.collect_set(F.struct("entity", "identity"))).alias("graph"))
    known = events.select("event", words.alias("n_tokens"), F.col("episode").cast("string").alias("episode")).join(linked, "event", "left")
    proof = evidence.select("claim", F.col("id").alias("proof"), "event").join(known, "event")
    wanted = seeds.select("request", "claim").distinct()
    some = min(budget.nodes, budget.edges, budget.evidence, budget.tokens) > 0
    fits = proof.groupBy("claim").agg(F.max((F.col("n_tokens") <= budget.tokens) & F.lit(some)).alias("fits"))
    rows = wanted.join(fits, "claim", "left").join(proof, "claim", "left").select("request", (~F.coalesce("fits", F.lit(False))).alias("late"), "claim", "proof", "n_tokens", "episode", "graph")
    kind = rows.schema["request"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if run is None or row.request != run.request:
                    out += [] if run is None else run.end()
                    run = _Expansion(row.request, budget)
                out += run.take(row)
            yield pd.DataFrame(out, columns=["request", *(c.split()[0] for c in EXPANDED.split(", "))])
        if run is not None:
            yield pd.DataFrame(run.end(), columns=["request", *(c.split()[0] for c in EXPANDED.split(", "))])

    workers_import(seeds.sparkSession)
    ordered = rows.repartition("request").sortWithinPartitions("request", "late", "claim", "proof")
    ordered = ordered.select("request", F.col("claim").cast("string"), F.col("proof").cast("string"), "n_tokens", "episode", "graph")
    return ordered.mapInPandas(fold, f"request {kind}, {EXPANDED}")


class _Expansion:
    """One request's budget as it is used up."""

    def __init__(self, request, budget: Budget):
        self.request, self.budget, self.seen, self.truncated = request, budget, set(), False
        self.nodes = self.edges = self.evidence = self.tokens = self.place = 0
        self.claim, self.open = None, False

    def _row(self, kind: str, node: str, tokens: int | None = None) -> tuple:
        self.place += 1
        return self.request, kind, str(node), self.place, tokens, False

    def _admit(self, kind: str, node) -> list[tuple]:
        if node is None or node != node or (kind, node) in self.seen:
            return []
        if self.nodes == self.budget.nodes or self.edges == self.budget.edges:
            self.truncated = True
            return []
        self.seen.add((kind, node))
        self.nodes, self.edges = self.nodes + 1, self.edges + 1
        return [self._row(kind, node)]

    def take(self, row) -> list[tuple]:
        out = []
        if row.claim != self.claim:
            self.claim, self.open = row.claim, self.nodes < self.budget.nodes
            self.truncated |= not self.open
            if self.open:
                self.nodes += 1
                out.append(self._row("claim", row.claim))
        if not self.open or row.proof is None or row.proof != row.proof:
            return out
        n = int(row.n_tokens)
        if self.evidence == self.budget.evidence or self.edges == self.budget.edges or n > self.budget.tokens - self.tokens:
            self.truncated = True
            return out
        self.tokens, self.edges, self.evidence = self.tokens + n, self.edges + 1, self.evidence + 1
        out.append(self._row("evidence", row.proof, n))
        out += self._admit("episode", row.episode)
        for link in row.graph if row.graph is not None else ():
            out += self._admit("entity", link["entity"]) + self._admit("identity", link["identity"])
        return out

    def end(self) -> list[tuple]:
        return [(self.request, "end", "", self.place + 1, self.tokens, self.truncated)]
