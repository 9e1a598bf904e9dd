"""Whether evidence answers a question: a veto on missing answers, and a calibrated score.

The veto knows four shapes of answers (a person, a count, a duration, a date).
A text relates an answer to the question where a value of that shape stands in
one clause with a word of the question, within a few words of it.  The veto can
only take evidence away.  The score is a logistic unit over six features that
don't depend on the wording.  Everything is column functions over arrays of
tokens, so a table of (question, text) rows needs no join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import STOP, content_terms, coverage

PERSON, COUNT, DURATION, DATE = "person", "count", "duration", "date"
NOT_APPLICABLE, SUPPORTED, UNSUPPORTED = "not_applicable", "supported", "unsupported"

#: Words by which questions and values are told.
GENERIC = ("count", "date", "deadline", "due", "duration", "long", "many", "number", "set", "total", "who", "whom")
BEFORE_RELATION = ("a", "an", "did", "does", "has", "have", "is", "the", "was", "were", "who", "whom")
ATTRIBUTIONS = ("by", "from", "name", "named", "names", "owner", "technician")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
NOBODY = ("anybody", "anyone", "nobody", "no-one", "person", "somebody", "someone", "today", "tomorrow", "tonight", "unknown", "yesterday")
NUMBERS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty",
    "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand",
)
UNITS = (
    "ms", "millisecond", "milliseconds", "second", "seconds", "sec", "secs", "minute", "minutes", "min", "mins",
    "hour", "hours", "hr", "hrs", "day", "days", "week", "weeks",
)
SPANS = ("overnight", "all-day", "daylong", "weeklong")
NUMBERED = ("build", "issue", "pr", "revision", "version")
DUE = ("by", "deadline", "due")
DATED = ("at", "for", "is", "on", "opens", "scheduled")
CURRENT = ("current", "currently", "latest", "now")
SUFFIXES = ("ing", "ed", "es", "s")
#: The score's means, scales, weights, intercept and threshold, in the order of FEATURES; it has not qualified.
FEATURES = ("cosine", "margin", "query_coverage", "document_coverage", "agreement", "novelty")
MEANS = (0.7879208, 0.17646733, 0.7673611, 0.61939484, 1.0, 0.76770836)
SCALES = (0.04541361, 0.06122231, 0.18011564, 0.23897444, 0.000001, 0.34929088)
WEIGHTS = (-0.20884588, -0.34937483, -0.43120468, 0.47956228, 0.0, 0.9991207)
INTERCEPT, THRESHOLD, QUALIFIED = -0.048190568, 0.3131644, False

_WORD = r"[\p{IsAlphabetic}\p{N}_-]+"
_TOKEN = r"[\p{IsAlphabetic}\p{N}_/:-]+"
_SMALL = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """A question's words, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), *_SMALL), F.lit(_WORD), F.lit(0))


def _content(word: Column) -> Column:
    """Whether a word carries content."""
    return (F.octet_length(word) >= 2) & ~word.isin(*STOP)


def answer_shape(question_words: Column) -> Column:
    """The shape of answer that a question asks for; null for any other question."""
    joined = F.concat(F.lit(" "), F.array_join(question_words, " "), F.lit(" "))
    has = lambda *phrases: F.array_max(F.array(*[F.contains(joined, F.lit(f" {p} ")) for p in phrases]))
    return F.when(has("how long", "duration"), DURATION).when(has("how many", "count"), COUNT).when(has("due date", "deadline", "date"), DATE).when(has("who", "whom"), PERSON)


def anchors(question_words: Column) -> Column:
    """The words of a question by which a value must stand."""
    return F.array_distinct(F.filter(question_words, lambda w: ~w.isin(*GENERIC) & _content(w)))


def stem(word: Column) -> Column:
    out = F.when(F.lit(False), word)
    for s in SUFFIXES:
        out = out.when((F.octet_length(word) > len(s) + 3) & word.endswith(s), F.left(word, F.length(word) - len(s)))
    return out.otherwise(word)


def relation(question_words: Column) -> Column:
    """The stem of the verb after who or whom; null without one."""
    asks = F.transform(question_words, lambda w: w.isin("who", "whom"))
    after = F.slice(question_words, F.array_position(asks, True).cast("int") + 1, F.size(question_words))
    return F.when(F.array_contains(asks, True), stem(F.get(F.filter(after, lambda w: ~w.isin(*BEFORE_RELATION)), F.lit(0))))


def body(text: Column) -> Column:
    """A text without the header of its context."""
    text = F.coalesce(text, F.lit(""))
    end = F.locate("]\n", text)
    return F.when(text.startswith("[app=") & (end > 0), F.substring(text, end + 2, F.length(text))).otherwise(text)


def tokens(text: Column) -> Column:
    """The tokens of a text without its header, in order: (t, clause, named): named if it begins like a name."""
    letter = r"^\P{IsAlphabetic}*"
    named = lambda raw: raw.rlike(letter + r"\p{IsUppercase}") & raw.rlike(letter + r"\p{IsAlphabetic}.*\p{IsLowercase}")
    cut = lambda clause, k: F.transform(F.regexp_extract_all(clause, F.lit(_TOKEN), F.lit(0)), lambda raw: F.struct(F.translate(raw, *_SMALL).alias("t"), k.alias("clause"), named(raw).alias("named")))
    return F.flatten(F.transform(F.split(body(text), r"[.;!?\n]"), cut))


def _digits(t: Column) -> Column:
    return t.rlike(r"^[0-9]+$")


def related(shape: Column, question_words: Column, text: Column) -> Column:
    """Whether a text relates a value of the shape to the question; null without a shape."""
    bound = F.array(F.struct(tokens(text).alias("all"), question_words.alias("asked"), anchors(question_words).alias("anchors"), relation(question_words).alias("relation")))
    return F.when(shape.isNotNull(), F.element_at(F.transform(bound, lambda q: _related(shape, q)), 1))  # bound once, used often


def _related(shape: Column, q: Column) -> Column:
    all_, asked, wanted = q["all"], q["asked"], q["anchors"]
    at = lambda i: F.get(all_, i)["t"]
    known = lambda t: F.array_contains(asked, t)

    def near(i: Column, radius: int, holds: Callable[[Column], Column], same_clause: bool = True) -> Column:
        begin = F.greatest(i - radius, F.lit(0))
        around = F.slice(all_, begin + 1, i + radius - begin + 1)
        return F.exists(around, lambda x: holds(x["t"]) & (x["clause"] == F.get(all_, i)["clause"]) if same_clause else holds(x["t"]))

    anchored = lambda i, radius: near(i, radius, lambda t: F.array_contains(wanted, t))

    def person(i: Column) -> Column:
        t = at(i)
        pieces = F.regexp_extract_all(t, F.lit(_WORD), F.lit(0))
        new = F.get(all_, i)["named"] & ~known(t) & ~t.isin(*MONTHS, *WEEKDAYS, *NOBODY) & F.exists(pieces, _content)
        verb = F.coalesce(near(i, 3, lambda x: stem(x) == q["relation"]), F.lit(False))
        topic = near(i, 5, lambda x: F.array_contains(wanted, x) & F.coalesce(stem(x) != q["relation"], F.lit(True)))
        return new & ((verb & topic) | (near(i, 3, lambda x: x.isin(*ATTRIBUTIONS), same_clause=False) & anchored(i, 5)))

    def count(i: Column) -> Column:
        value = _digits(at(i)) | at(i).isin(*NUMBERS)
        return value & ~known(at(i)) & F.coalesce(~F.get(all_, F.when(i > 0, i - 1))["t"].isin(*NUMBERED), F.lit(True)) & anchored(i, 2)

    def duration(i: Column) -> Column:
        t = at(i)
        apart = (_digits(t) | t.isin(*NUMBERS)) & F.coalesce(at(i + 1).isin(*UNITS), F.lit(False))
        return ~known(t) & (apart | t.rlike(rf"^[0-9]+(?:{'|'.join(UNITS)})$") | t.isin(*SPANS)) & anchored(i, 4)

    def date(i: Column) -> Column:
        t = at(i)
        written = t.rlike(r"^[0-9]+(?:-[0-9]+-|/[0-9]+/)[0-9]+$")
        value = ~known(t) & (t.isin(*WEEKDAYS, "today", "tomorrow", "tonight") | written | (t.isin(*MONTHS) & F.coalesce(_digits(at(i + 1)), F.lit(False))))
        due = F.exists(asked, lambda w: w.isin("due", "deadline"))
        return value & F.when(due, near(i, 3, lambda x: x.isin(*DUE)) & anchored(i, 5)).otherwise(anchored(i, 4) & near(i, 4, lambda x: x.isin(*DATED)))

    places = F.sequence(F.lit(0), F.size(all_) - 1)
    found = F.when(shape == PERSON, F.exists(places, person)).when(shape == COUNT, F.exists(places, count)).when(shape == DURATION, F.exists(places, duration)).otherwise(F.exists(places, date))
    return F.when(F.size(all_) > 0, found).otherwise(False)


def supersedes(question_words: Column, text: Column) -> Column:
    """Whether a question asks for the current state and the text says that it replaces a previous one."""
    small = F.translate(body(text), *_SMALL)
    return F.exists(question_words, lambda w: w.isin(*CURRENT)) & (F.contains(small, F.lit("supersedes")) | F.contains(small, F.lit("replaces"))) & F.contains(small, F.lit("previous"))


def explicit_relations(pairs: DataFrame, *keys: str, question: str = "question", text: str = "text") -> DataFrame:
    """(*keys, signal, superseding) from rows of a question (keys) with one candidate text each, pre-aggregated."""
    w = words(F.col(question))
    rows = pairs.select(*keys, answer_shape(w).alias("shape"), w.alias("w"), F.col(text).alias("t"))
    rows = rows.select(*keys, "shape", related(F.col("shape"), F.col("w"), F.col("t")).alias("related"), supersedes(F.col("w"), F.col("t")).alias("superseding"))
    found = rows.groupBy(*keys).agg(F.max("shape").alias("shape"), F.max("related").alias("related"), F.max("superseding").alias("superseding"))
    signal = F.when(F.col("shape").isNull(), NOT_APPLICABLE).when(F.col("related"), SUPPORTED).otherwise(UNSUPPORTED)
    return found.select(*keys, signal.alias("signal"), "superseding")


def novelty(question: Column, text: Column) -> Column:
    """The longest content term that only the text has, against the question's longest; 1 at most."""
    longest = lambda terms: F.array_max(F.transform(terms, F.length))
    new = F.coalesce(longest(F.array_except(content_terms(text), content_terms(question))), F.lit(0))
    return F.least(new / F.coalesce(longest(content_terms(question)), F.lit(1)), F.lit(1.0))


def features(candidates: DataFrame, *keys: str, question: str = "question", text: str = "text") -> DataFrame:
    """(*keys, *FEATURES) of each question's candidates (keys, id, cosine, question, text), bounded pools.

    The best by cosine and the best by words, ties to the smaller id; of the
    latter the coverage both ways and the novelty.
    """
    q, t = F.col(question), F.col(text)
    rows = candidates.select(*keys, "id", "cosine", coverage(q, t).alias("q"), coverage(t, q).alias("d"), novelty(q, t).alias("n"))
    near = F.min(F.struct((-F.col("cosine")).alias("c"), "id"))
    lexical = F.min(F.struct((-F.col("q")).alias("q"), (-F.col("d")).alias("d"), "id", "n"))
    two = F.slice(F.sort_array(F.collect_list("cosine"), asc=False), 1, 2)
    found = rows.groupBy(*keys).agg(near.alias("s"), lexical.alias("l"), two.alias("t"))
    return found.select(
        *keys,
        (-F.col("s.c")).alias("cosine"),
        F.when(F.size("t") > 1, F.greatest(F.get("t", F.lit(0)) - F.get("t", F.lit(1)), F.lit(0.0))).otherwise(0.0).alias("margin"),
        (-F.col("l.q")).alias("query_coverage"),
        (-F.col("l.d")).alias("document_coverage"),
        (F.col("s.id") == F.col("l.id")).cast("double").alias("agreement"),
        F.col("l.n").alias("novelty"),
    )


def sufficiency(features: dict[str, Column]) -> Column:
    """The score of a question's six features; null where one is missing or out of its range."""
    share = lambda c: (c >= 0) & (c <= 1)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    valid = features["margin"] >= 0
    for name in FEATURES:
        valid = valid & finite(features[name])
    valid = valid & share(features["query_coverage"]) & share(features["document_coverage"]) & share(features["novelty"]) & features["agreement"].isin(0.0, 1.0)
    logit = F.lit(INTERCEPT)
    for name, mean, scale, weight in zip(FEATURES, MEANS, SCALES, WEIGHTS):
        logit = logit + weight * ((features[name] - mean) / scale)
    return F.when(valid, 1 / (1 + F.exp(-logit)))


def outcome(n_hits: Column, embedded: Column, signal: Column, superseding: Column, verdict: Column, score: Column, qualified: bool = QUALIFIED) -> Column:
    """matched, contradicted, nothing_matched, or degraded with its reason.

    verdict: supported, contradicted or insufficient, or null where no verifier
    has spoken; then the score decides, once it has qualified.
    """
    vetoed = (signal == UNSUPPORTED) & ~superseding
    by_score = F.when(F.coalesce(score >= THRESHOLD, F.lit(False)), "matched").otherwise("nothing_matched") if qualified else F.lit("degraded: not qualified")
    return (
        F.when(~embedded, "degraded: no embeddings")
        .when((n_hits == 0) | vetoed, "nothing_matched")
        .when(verdict == "supported", "matched")
        .when(verdict == "contradicted", "contradicted")
        .when(verdict.isNotNull(), "nothing_matched")
        .otherwise(by_score)
    )
