"""Finding moments: lexical and vector scores, ranks, fusion, evidence.

BM25 works with or without an index, over stems without diacritics.  `bm25`
scans: one pass gives document frequencies and lengths of the query's terms as a
single row, a second scores every text in a projection; nothing but that row and
the best k rows is exchanged.  It is for few or changing rows; stored tables have
`textindex`, which reads the postings of the terms and no text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions import stems
from tidelog.functions.text import STOP
from tidelog.operators import evidence
from tidelog.operators.textindex import TextIndex, terms, weight
from tidelog.sources.tables import workers_import

#: Weights of the five arms, the half-life of recency, and the rows each arm gives.
SEMANTIC, LEXICAL, RECENCY, ENTITY, SOURCE = 0.40, 0.30, 0.10, 0.15, 0.05
HALF_LIFE_H, POOL = 24.0, 200
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Each side of an anchor.
ANCHOR = 300_000_000
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


@dataclass(frozen=True)
class Route:
    shape: str  # "plain", "anchor" or "range"
    start: int | None = None
    end: int | None = None


def time_range(text: str, now: int) -> tuple[int, int] | None:
    """The coarse range that a phrase names, before a fixed `now`."""
    q, before = text.lower(), lambda days: max(0, now - days * DAY)
    if "yesterday" in q:
        return before(2), before(1)
    if any(f"this {part}" in q for part in ("morning", "afternoon", "evening")):
        return before(1), now
    if "last week" in q or any(f"last {day}" in q for day in WEEKDAYS):
        return before(14), before(7)
    return (before(7), now) if any(day in q for day in WEEKDAYS) else None


def route(text: str, now: int) -> Route:
    q = text.lower()
    if any(f"{how} {side} " in q for how in ("right", "just") for side in ("before", "after")):
        return Route("anchor")
    found = time_range(q, now)
    return Route("range", *found) if found else Route("plain")


def intersection(a: tuple[int | None, int | None], b: tuple[int | None, int | None]) -> tuple[int | None, int | None]:
    """Both ranges at once; may be inverted, which matches nothing."""
    starts, ends = [x[0] for x in (a, b) if x[0] is not None], [x[1] for x in (a, b) if x[1] is not None]
    return max(starts, default=None), min(ends, default=None)


def phrases(text: str) -> list[list[str]]:
    """A question as terms and phrases: what isn't a bare word between blanks is a phrase of its words."""
    return [words for part in text.split() if (words := re.findall(r"[^\W_]+", part.lower()))]


def relaxed_terms(text: str, most: int = 12) -> list[str]:
    """The distinct words of a question that are no stop words, the first `most`."""
    return list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) > 1 and w not in STOP))[:most]


def expanded(text: str, groups: list[list[str]]) -> list[list[str]]:
    """Phrases of the spellings of every alias group that has one in the text."""
    q = text.lower()
    return [phrase for group in groups if any(s.lower() in q for s in group) for s in group for phrase in [re.findall(r"[^\W_]+", s.lower())] if phrase]


def _hits(words, phrase: list[str]):
    """At how many places a phrase begins."""
    if len(phrase) == 1:
        return F.size(words) - F.size(F.array_remove(words, phrase[0]))
    begins = lambda x, i: reduce(lambda a, b: a & b, [x == phrase[0], *[F.coalesce(F.get(words, i + j) == p, F.lit(False)) for j, p in enumerate(phrase[1:], 1)]])
    return F.size(F.filter(F.transform(words, begins), lambda b: b))


def bm25(rows: DataFrame, wanted: list[list[str]], text: str = "text", every: bool = True, out: str = "score") -> DataFrame:
    """rows that have all (or, with every=False, any) of the phrases, with their BM25 score, higher better."""
    wanted = [found for p in wanted if (found := stems.terms(" ".join(p)))]
    if not wanted:
        return rows.where(F.lit(False)).withColumn(out, F.lit(0.0))
    workers_import(rows.sparkSession)
    words = rows.withColumn("__w", terms(F.col(text)))
    # A generated row of counts, through which no condition moves: else each condition would cut the text into words again.
    counts = F.struct(F.size("__w").alias("__dl"), *[_hits(F.col("__w"), p).alias(f"__tf{i}") for i, p in enumerate(wanted)])
    counted = words.select(*rows.columns, F.explode(F.array(counts)).alias("__tf")).select(*rows.columns, "__tf.*")
    tf = [F.col(f"__tf{i}") for i in range(len(wanted))]
    corpus = counted.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *[F.count_if(t > 0).alias(f"__df{i}") for i, t in enumerate(tf)])  # one row
    keep = tf[0] > 0
    for t in tf[1:]:
        keep = (keep & (t > 0)) if every else (keep | (t > 0))
    scored = counted.where(keep).join(F.broadcast(corpus))
    total = F.lit(0.0)
    for i, t in enumerate(tf):
        total = total + weight(t, F.col(f"__df{i}"), F.col("__n"), F.col("__dl"), F.col("__avg"))
    return scored.select(*rows.columns, total.alias(out))


def capitalised(text: str, most: int = 24) -> list[str]:
    """Words of a question that begin with a capital, and pairs of such, in order: what may be names."""
    words = [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", t) for t in text.split()) if w]
    out = []
    for i, w in enumerate(words):
        if w[0].isupper():
            out += [w] + ([f"{w} {words[i + 1]}"] if i + 1 < len(words) and words[i + 1][0].isupper() else [])
    return list(dict.fromkeys(out))[:most]


def relaxed_hits(index: TextIndex, text: str) -> DataFrame:
    """(id, score, relaxed) from an index, as `relaxed` gives them."""
    return _first_unless_empty(index.hits(phrases(text)), index.hits([[t] for t in relaxed_terms(text)], every=False))


def relaxed(rows: DataFrame, text: str, column: str = "text") -> DataFrame:
    """All terms if any row has them, else any of the content terms; `relaxed` says which."""
    strict, loose = bm25(rows, phrases(text), column), bm25(rows, [[t] for t in relaxed_terms(text)], column, every=False)
    return _first_unless_empty(strict, loose)


def _first_unless_empty(strict: DataFrame, loose: DataFrame) -> DataFrame:
    some = strict.limit(1).agg((F.count("*") > 0).alias("__some"))  # one row
    both = strict.withColumn("relaxed", F.lit(False)).union(loose.withColumn("relaxed", F.lit(True)))
    return both.join(F.broadcast(some)).where(F.col("relaxed") != F.col("__some")).drop("__some")


def vector_scores(rows: DataFrame, query: list[float], vector: str = "embedding", out: str = "score") -> DataFrame:
    """rows with their dot product with the query, in doubles; vectors of another size are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.where(F.size(vector) == len(query)).withColumn(out, dot)


def best(rows: DataFrame, k: int, score: str = "score", id_: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(score), id_).limit(k)


def reciprocal(rows: DataFrame, score: str, out: str) -> DataFrame:
    """rows with 1 / rank, equal scores sharing the rank of the first; for pools of bounded size."""
    return rows.withColumn(out, 1.0 / F.rank().over(W.orderBy(F.desc(score))))


def recency(ts, now, half_life_h: float = HALF_LIFE_H):
    """1 now, 1/2 a half-life ago; the future counts as now; without a half-life only now counts."""
    hours = F.greatest(F.lit(now) - ts, F.lit(0)) / HOUR
    if half_life_h <= 0:
        return F.when(hours == 0, 1.0).otherwise(0.0)
    return F.exp(-math.log(2) * hours / half_life_h)


def fused(semantic: DataFrame, lexical: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """The five arms as one score.

    semantic, lexical: (id, score), each the best of its arm; facts: (id,
    recency, mentions, source) of at least the ids of both.
    """
    return ranked(pooled(semantic, lexical).join(facts, "id"), k)


def pooled(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """(id, rr_semantic, rr_lexical): at most twice POOL rows, small enough to broadcast."""
    sem = reciprocal(semantic, "score", "rr_semantic").select("id", "rr_semantic")
    lex = reciprocal(lexical, "score", "rr_lexical").select("id", "rr_lexical")
    return sem.join(lex, "id", "full")


def ranked(pool: DataFrame, k: int) -> DataFrame:
    """The k best of a pool of (id, rr_semantic, rr_lexical, recency, mentions, source)."""
    most = F.max("mentions").over(W.partitionBy(F.lit(0)))  # a pool of at most twice POOL rows
    entity = F.when(most > 0, F.col("mentions") / most).otherwise(0.0)
    rr = lambda c: F.coalesce(c, F.lit(0.0))
    score = SEMANTIC * rr("rr_semantic") + LEXICAL * rr("rr_lexical") + RECENCY * F.col("recency") + ENTITY * entity + SOURCE * F.col("source")
    return best(pool.withColumn("score", F.round(score, 9)), k)


def min_max(rows: DataFrame, score: str, out: str, *keys: str) -> DataFrame:
    """Scores scaled to 0..1 within keys; 1/2 where all are equal."""
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    low, high = F.min(score).over(part), F.max(score).over(part)
    return rows.withColumn(out, F.when(high == low, 0.5).otherwise((F.col(score) - low) / (high - low)))


def evidence_features(candidates: DataFrame, query: str) -> DataFrame:
    """One row: the features of a question's POOL nearest candidates (id, cosine, text)."""
    top = best(candidates.select("id", "cosine", "text"), POOL, "cosine").withColumn("question", F.lit(query))
    return evidence.features(top)


def adjusted_relevance(score, decay, age_us):
    """A lexical score faded by decay and age: exp(-2 decay days)."""
    return F.greatest(score, F.lit(0.0)) * F.exp(-decay * 2.0 * age_us / DAY)


def diverse(candidates: DataFrame, keys: list[str], n: int = 5, weight: float = 0.5, text: str = "words", score: str = "score") -> DataFrame:
    """Greedy maximal marginal relevance in each group of candidates, which are bounded pools.

    Each step takes the highest weight * score / top - (1 - weight) * similarity
    to the nearest chosen; of equals the last in order of id.  Adds `place`.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").reset_index(drop=True)
        sets, top = [frozenset(w) for w in group[text]], max(float(group[score].max()), 2.220446049250313e-16)
        left, chosen = list(range(len(group))), []
        alike = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        while left and len(chosen) < n:
            value = lambda i: weight * group[score][i] / top - (1 - weight) * max((alike(sets[i], sets[j]) for j in chosen), default=0.0)
            chosen.append(max(left, key=lambda i: (value(i), i)))
            left.remove(chosen[-1])
        out = group.loc[chosen].copy()
        out["place"] = range(1, len(chosen) + 1)
        return out

    return candidates.groupBy(*keys).applyInPandas(pick, candidates.withColumn("place", F.lit(0).cast("int")).schema)


def excerpt(text, terms: list[str], around: int = 80):
    """A window of characters about the first query term, else the beginning; ellipses where it was cut."""
    places = [F.locate(t, F.lower(text)) for t in terms]
    first = F.array_min(F.filter(F.array(*places), lambda p: p > 0)) if places else F.lit(None)
    begin = F.greatest(F.coalesce(first, F.lit(1)) - around, F.lit(1))
    piece = F.substring(text, begin, F.lit(2 * around))
    return F.concat(F.when(begin > 1, "…").otherwise(""), piece, F.when(begin + 2 * around <= F.length(text), "…").otherwise(""))


def routed(rows: DataFrame, now: int, text: str = "text") -> DataFrame:
    """rows of questions with shape, start and end: `route` for a whole table."""
    q = F.lower(F.coalesce(F.col(text), F.lit("")))
    any_of = lambda parts: F.array_max(F.array(*[q.contains(p) for p in parts]))
    before = lambda days: F.lit(max(0, now - days * DAY))
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    found = (
        F.when(q.contains("yesterday"), span(before(2), before(1)))
        .when(any_of([f"this {p}" for p in ("morning", "afternoon", "evening")]), span(before(1), F.lit(now)))
        .when(any_of(["last week", *(f"last {d}" for d in WEEKDAYS)]), span(before(14), before(7)))
        .when(any_of(WEEKDAYS), span(before(7), F.lit(now)))
    )
    anchor = any_of([f"{how} {side} " for how in ("right", "just") for side in ("before", "after")])
    out = rows.withColumn("__range", F.when(~anchor, found))
    shape = F.when(anchor, "anchor").when(F.col("__range").isNotNull(), "range").otherwise("plain")
    return out.select(*rows.columns, shape.alias("shape"), F.col("__range.start").alias("start"), F.col("__range.end").alias("end"))


def expanded_rows(questions: DataFrame, groups: DataFrame, text: str = "text", gram: int = 4) -> DataFrame:
    """(id, spelling): every spelling of each alias group that has one in a question's text.  groups: (group, spelling).

    Spellings match inside words too.  Each is found by its rarest run of `gram`
    characters (a shorter one by itself), which a question's runs of that length
    meet in an equi-join; then the whole spelling is looked for.  So neither side
    is broadcast, whatever their numbers.
    """
    spelt = groups.select("group", "spelling", F.lower("spelling").alias("s")).where("s <> ''").distinct()

    def runs(column, n):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(column) - n + 1, F.lit(1))), lambda i: F.substring(column, i, n)))

    cut = spelt.select("s").distinct().select("s", F.least(F.length("s"), F.lit(gram)).alias("n"))
    cut = cut.select("s", "n", F.explode(runs(F.col("s"), F.col("n"))).alias("run"))
    common = cut.groupBy("n", "run").agg(F.count("*").alias("f"))
    keyed = cut.join(common, ["n", "run"]).groupBy("s").agg(F.min(F.struct("f", "n", "run")).alias("k")).select("s", "k.n", "k.run")
    lengths = F.array(*[F.lit(n) for n in range(1, gram + 1)])
    asked = questions.select("id", F.lower(F.coalesce(F.col(text), F.lit(""))).alias("q")).where("q <> ''").withColumn("n", F.explode(lengths))
    asked = asked.where(F.length("q") >= F.col("n")).select("id", "q", "n", F.explode(runs(F.col("q"), F.col("n"))).alias("run"))
    asked = asked.join(keyed.select("n", "run").distinct(), ["n", "run"], "left_semi")
    found = asked.join(keyed, ["n", "run"]).where(F.contains("q", "s")).select("id", "s").distinct()
    return found.join(spelt, "s").select("id", "group").distinct().join(spelt, "group").select("id", "spelling").distinct()


def proposition_terms(text: str, most: int = 24) -> list[str]:
    """The sorted distinct words of three characters or more, the first `most`."""
    return sorted({w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) >= 3})[:most]


def propositions_about(rows: DataFrame, question: str) -> DataFrame:
    """Propositions (id, text, reasoning) with any of a question's words (as stems) in either column, with their BM25 score."""
    both = rows.withColumn("__both", F.concat_ws(" ", "text", "reasoning"))
    return bm25(both, [[w] for w in proposition_terms(question)], "__both", every=False).drop("__both")
