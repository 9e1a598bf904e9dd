"""Column functions on text: tokens, word sets, similarities, cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Words that carry no content in a question.
STOP = (
    "a", "an", "and", "are", "as", "at", "be", "did", "do", "for", "from", "how", "i", "in",
    "is", "it", "of", "on", "or", "the", "to", "was", "we", "what", "where", "which", "who",
    "why", "with",
)


def tokens(text):
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def content_terms(text):
    """Distinct terms of two characters or more that are no stop words."""
    terms = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))
    return F.array_distinct(F.filter(terms, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP)))


def long_words(text, least: int = 3):
    """The sorted set of words of at least `least` characters."""
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= least)))


def coverage(query, evidence):
    """The share of the query's content terms that the evidence has; 0 without terms."""
    q = content_terms(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, content_terms(evidence))) / F.size(q))


def jaccard(a, b):
    """Similarity of two word sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def restates(a, b):
    """Whether one word set says again what the other said: two words shared, and three in five of the shorter."""
    return restating(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def restating(shared, n_a, n_b):
    """The same by the numbers of words: shared, and of each set; columns or their names."""
    shared, n_a, n_b = (F.col(x) if isinstance(x, str) else x for x in (shared, n_a, n_b))
    return (shared >= 2) & (shared * 5 >= F.least(n_a, n_b) * 3)


def reworded(a, b):
    """Two searches that differ but share at least half of the smaller set of words."""
    return F.size(F.array_intersect(a, b)) * 2 >= F.least(F.size(a), F.size(b))


def squeezed(text):
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cut(text, chars: int):
    """At most `chars` characters, the last an ellipsis where something went."""
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars - 1)), F.lit("…"))).otherwise(text)


def word_count(text):
    """Words between white space: the token estimate of packets and handoffs."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0).otherwise(F.size(F.split(squeezed(text), " ")))


def ngrams(words, n: int):
    """Runs of n words joined by spaces."""
    return F.when(
        F.size(words) >= n,
        F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def changed_lines(now, before):
    """Lines of `now` that `before` doesn't have, repeated ones counted each."""
    return F.size(F.filter(lines(now), lambda x: ~F.array_contains(lines(before), x) & (F.trim(x) != "")))
