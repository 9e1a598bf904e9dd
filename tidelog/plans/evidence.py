"""Queries of evidence: does what was found answer the question?

Each order asks a question and its line items are what was found: notes written
from their columns, of every kind that the rules tell apart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import evidence as e
from tidelog.plans.registry import query
from tidelog.plans.search import _TERMS
from tidelog.sources.tables import table

QUESTIONS = (
    "Who approved order {}?", "How many parts are in order {}?", "How long did order {} take?", "What due date was set for order {}?",
    "Which date does order {} open?", "Why did order {} change?", "Who approved the current order {}?",
)
#: {0}: the order, {1}: the part, {2}: the day, {3}: a number.
NOTES = (
    "Mara approved order {0}.", "Order {0} holds {3} parts; version 3 was sent.", "The run of order {0} took {3} days.", "Order {0} is due on {2}.",
    "Order {0} was filed. Mara approved part {1}.", "[app=shop | due={2}]\nOrder {0} supersedes the previous one.", "Order {0} opens on Monday",
    "Nobody told order {0} from build 12\nby Lee", "[app=shop]\nWork on order {0} was named by Sam, overnight!",
)


def _written(forms, at, *values):
    """The form that a row's number picks, with its values in it."""
    out = F.element_at(F.array(*map(F.lit, forms)), (at + 1).cast("int"))
    for i, v in enumerate(values):
        out = F.replace(out, F.lit(f"{{{i}}}" if len(values) > 1 else "{}"), v.cast("string"))
    return out


def _sql(forms, at: str, *values: str) -> str:
    listed = ", ".join("'" + f.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for f in forms)
    out = f"([{listed}])[{at} + 1]"
    for i, v in enumerate(values):
        out = f"replace({out}, '{{{i}}}', {v}::VARCHAR)" if len(values) > 1 else f"replace({out}, '{{}}', {v}::VARCHAR)"
    return out


def pairs(spark, sf):
    """(question_id, id, question, text, supplier): a row for each note found for a question."""
    items = table(spark, sf, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    o, i = F.col("l_orderkey"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    text = _written(NOTES, (F.col("l_linenumber") * 5 + F.col("l_suppkey")) % len(NOTES), o, F.col("l_partkey"), F.col("day"), F.col("l_quantity").cast("int"))
    return items.select(o.alias("question_id"), i.alias("id"), _written(QUESTIONS, o % len(QUESTIONS), o).alias("question"), text.alias("text"), F.col("l_suppkey").alias("supplier"))


_PAIRS = f"""p AS (SELECT l_orderkey AS question_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, {_sql(QUESTIONS, f'l_orderkey % {len(QUESTIONS)}', 'l_orderkey')} AS question,
    {_sql(NOTES, f'(l_linenumber * 5 + l_suppkey) % {len(NOTES)}', 'l_orderkey', 'l_partkey', "strftime(l_shipdate, '%Y-%m-%d')", 'l_quantity::INT')} AS text, l_suppkey AS supplier FROM lineitem)"""


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _stem(column: str) -> str:
    return "CASE " + " ".join(f"WHEN strlen({column}) > {len(s) + 3} AND ends_with({column}, '{s}') THEN {column}[:-{len(s) + 1}]" for s in e.SUFFIXES) + f" ELSE {column} END"


def _near(radius: int, holds: str, clause: bool = True) -> str:
    return f"EXISTS (SELECT 1 FROM t n WHERE n.id = t.id AND n.i BETWEEN t.i - {radius} AND t.i + {radius} AND {holds}" + (" AND n.k = t.k)" if clause else ")")


_ANCHOR = "list_contains(t.anchors, n.t)"
_NEXT = "(SELECT n.t FROM t n WHERE n.id = t.id AND n.i = t.i + 1)"
_LAST = "(SELECT n.t FROM t n WHERE n.id = t.id AND n.i = t.i - 1)"
_NUMBER = f"(regexp_matches(t.t, '^[0-9]+$') OR {_in('t.t', e.NUMBERS)})"
_DUE = "len(list_filter(t.w, lambda x: x IN ('due', 'deadline'))) > 0"
#: CTEs ending in s (question_id, signal, superseding): tokens as rows, met by their places.
_SIGNALS = rf"""{_PAIRS}, q AS (SELECT *, regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_-]+') AS w,
    CASE WHEN starts_with(text, '[app=') AND contains(text, ']' || chr(10)) THEN substr(text, instr(text, ']' || chr(10)) + 2) ELSE text END AS body FROM p),
a AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS j, [x FOR x IN w IF NOT ({_in('x', e.GENERIC)}) AND strlen(x) >= 2 AND NOT ({_in('x', e.STOP)})] AS anchors,
    CASE WHEN list_contains(w, 'who') THEN [x FOR x IN w[list_position(w, 'who') + 1:] IF NOT ({_in('x', e.BEFORE_RELATION)})][1] END AS verb FROM q),
b AS (SELECT *, {_stem('verb')} AS relation, CASE WHEN regexp_matches(j, ' (how long|duration) ') THEN 'duration' WHEN regexp_matches(j, ' (how many|count) ') THEN 'count'
    WHEN regexp_matches(j, ' (due date|deadline|date) ') THEN 'date' WHEN regexp_matches(j, ' whom? ') THEN 'person' END AS shape FROM a),
c AS (SELECT *, string_split_regex(body, '[.;!?\n]') AS cs FROM b), d AS (SELECT *, unnest(cs) AS clause, unnest(range(len(cs))) AS k FROM c),
r AS (SELECT question_id, id, shape, w, anchors, relation, k, unnest(regexp_extract_all(clause, '[\p{{L}}\p{{N}}_/:-]+')) AS raw, generate_subscripts(regexp_extract_all(clause, '[\p{{L}}\p{{N}}_/:-]+'), 1) AS m FROM d),
t AS (SELECT *, lower(raw) AS t, row_number() OVER (PARTITION BY id ORDER BY k, m) AS i, regexp_matches(raw, '^[^\p{{L}}]*\p{{Lu}}') AND regexp_matches(raw, '^[^\p{{L}}]*\p{{L}}.*\p{{Ll}}') AS named FROM r),
v AS (SELECT DISTINCT id FROM t WHERE NOT list_contains(w, t) AND CASE shape
    WHEN 'person' THEN named AND NOT ({_in('t.t', e.MONTHS + e.WEEKDAYS + e.NOBODY)}) AND len([x FOR x IN regexp_extract_all(t.t, '[\p{{L}}\p{{N}}_-]+') IF strlen(x) >= 2 AND NOT ({_in('x', e.STOP)})]) > 0 AND
        (({_near(3, _stem('n.t') + ' = t.relation')} AND {_near(5, _ANCHOR + ' AND ' + _stem('n.t') + ' IS DISTINCT FROM t.relation')}) OR ({_near(3, _in('n.t', e.ATTRIBUTIONS), False)} AND {_near(5, _ANCHOR)}))
    WHEN 'count' THEN {_NUMBER} AND NOT coalesce({_in(_LAST, e.NUMBERED)}, false) AND {_near(2, _ANCHOR)}
    WHEN 'duration' THEN (({_NUMBER} AND coalesce({_in(_NEXT, e.UNITS)}, false)) OR regexp_matches(t.t, '^[0-9]+({'|'.join(e.UNITS)})$') OR {_in('t.t', e.SPANS)}) AND {_near(4, _ANCHOR)}
    WHEN 'date' THEN ({_in('t.t', e.WEEKDAYS + ('today', 'tomorrow', 'tonight'))} OR regexp_matches(t.t, '^[0-9]+(-[0-9]+-|/[0-9]+/)[0-9]+$') OR ({_in('t.t', e.MONTHS)} AND coalesce(regexp_matches({_NEXT}, '^[0-9]+$'), false)))
        AND CASE WHEN {_DUE} THEN {_near(3, _in('n.t', e.DUE))} AND {_near(5, _ANCHOR)} ELSE {_near(4, _ANCHOR)} AND {_near(4, _in('n.t', e.DATED))} END END),
s AS (SELECT question_id, CASE WHEN max(shape) IS NULL THEN 'not_applicable' WHEN bool_or(v.id IS NOT NULL) THEN 'supported' ELSE 'unsupported' END AS signal,
    bool_or(len(list_filter(w, lambda x: {_in('x', e.CURRENT)})) > 0 AND regexp_matches(lower(body), 'supersedes|replaces') AND contains(lower(body), 'previous')) AS superseding
    FROM b LEFT JOIN v USING (id) GROUP BY question_id)"""


@query(f"WITH {_SIGNALS} SELECT * FROM s")
def explicit_relation(spark, sf):
    """The veto's signal for each question."""
    return e.explicit_relations(pairs(spark, sf), "question_id")


def scored(spark, sf):
    """(question_id, *FEATURES, score): cosines are those of the embeddings of the question's and the note's supplier."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("supplier"), F.col("embedding").cast("array<double>").alias("v"))
    asked = vectors.select(F.col("supplier").alias("asked"), F.col("v").alias("u"))
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = pairs(spark, sf).withColumn("asked", F.col("question_id") % 7).join(vectors, "supplier").join(asked, "asked")
    found = e.features(rows.withColumn("cosine", F.round(dot, 6)), "question_id")
    return found.select("*", e.sufficiency({c: F.col(c) for c in e.FEATURES}).alias("score"))


_LOGIT = " + ".join([f"{e.INTERCEPT}::DOUBLE", *(f"{w}::DOUBLE * ((f.{c} - {m}::DOUBLE) / {s}::DOUBLE)" for c, m, s, w in zip(e.FEATURES, e.MEANS, e.SCALES, e.WEIGHTS))])
_SCORES = f"""g AS (SELECT question_id, p.id, round(list_dot_product(list_transform(x.embedding, lambda z: z::DOUBLE), list_transform(y.embedding, lambda z: z::DOUBLE)), 6) AS c, {_TERMS.format('question')} AS qt, {_TERMS.format('text')} AS et
    FROM p JOIN embeddings x ON x.vec_id = supplier JOIN embeddings y ON y.vec_id = question_id % 7),
h AS (SELECT *, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, et)) / len(qt)::DOUBLE END AS qc, CASE WHEN len(et) = 0 THEN 0 ELSE len(list_intersect(qt, et)) / len(et)::DOUBLE END AS dc,
    least(coalesce(list_max([length(z) FOR z IN et IF NOT list_contains(qt, z)]), 0) / coalesce(list_max([length(z) FOR z IN qt]), 1)::DOUBLE, 1) AS nov,
    row_number() OVER (PARTITION BY question_id ORDER BY c DESC, id) AS near FROM g),
l AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY qc DESC, dc DESC, id) AS lex FROM h),
f AS (SELECT question_id, max(c) AS cosine, coalesce(max(c) FILTER (near = 1) - max(c) FILTER (near = 2), 0) AS margin, max(qc) FILTER (lex = 1) AS query_coverage, max(dc) FILTER (lex = 1) AS document_coverage,
    (max(id) FILTER (lex = 1) = max(id) FILTER (near = 1))::INT::DOUBLE AS agreement, max(nov) FILTER (lex = 1) AS novelty FROM l GROUP BY question_id)"""


@query(f"WITH {_PAIRS}, {_SCORES} SELECT question_id, {', '.join(f'round({c}, 6) AS {c}' for c in e.FEATURES)}, round(1 / (1 + exp(-({_LOGIT}))), 6) AS score FROM f")
def sufficiency_score(spark, sf):
    """The six features of each question and their score."""
    out = scored(spark, sf)
    return out.select("question_id", *[F.round(c, 6).alias(c) for c in (*e.FEATURES, "score")])


_VERDICT = "CASE question_id % 11 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'insufficient' END"


@query(f"""WITH {_SIGNALS}, {_SCORES}, n AS (SELECT question_id, count(*) AS hits FROM p GROUP BY question_id),
o AS (SELECT o_orderkey AS question_id, coalesce(hits, 0) AS hits, signal, superseding, {_VERDICT.replace('question_id', 'o_orderkey')} AS verdict, f.question_id IS NOT NULL AS embedded
    FROM orders LEFT JOIN n ON n.question_id = o_orderkey LEFT JOIN s ON s.question_id = o_orderkey LEFT JOIN f ON f.question_id = o_orderkey)
SELECT question_id, CASE WHEN NOT embedded AND hits > 0 THEN 'degraded: no embeddings' WHEN hits = 0 OR (signal = 'unsupported' AND NOT superseding) THEN 'nothing_matched' WHEN verdict = 'supported' THEN 'matched'
    WHEN verdict = 'contradicted' THEN 'contradicted' WHEN verdict IS NOT NULL THEN 'nothing_matched' ELSE 'degraded: not qualified' END AS outcome FROM o""")
def recall_outcomes(spark, sf):
    """The outcome of each order's question, from what its notes say; some have a verifier's verdict."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"))
    found = pairs(spark, sf)
    hits = found.groupBy("question_id").agg(F.count("*").alias("hits"))
    rows = orders.join(hits, "question_id", "left").join(e.explicit_relations(found, "question_id"), "question_id", "left")
    rows = rows.join(scored(spark, sf).select("question_id", "score", F.lit(True).alias("scored")), "question_id", "left")
    n, q = F.coalesce("hits", F.lit(0)), F.col("question_id") % 11
    verdict = F.when(q == 0, "supported").when(q == 1, "contradicted").when(q == 2, "insufficient")
    embedded = F.coalesce("scored", F.lit(False)) | (n == 0)
    return rows.select("question_id", e.outcome(n, embedded, F.coalesce("signal", F.lit(e.NOT_APPLICABLE)), F.coalesce("superseding", F.lit(False)), verdict, F.col("score")).alias("outcome"))
