"""Queries of search.  A vector and a document with one id count as one moment; `now` is the last event."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidelog.functions.text import content_terms, coverage, long_words, restating
from tidelog.functions.urls import source_quality
from tidelog.operators import search as s
from tidelog.operators.overlaps import packed, sharing
from tidelog.operators.store import top_per_group
from tidelog.operators.textindex import NAME, TextIndex, build, stored
from tidelog.plans.registry import query
from tidelog.sources.tables import micros, shared_folder, table

#: 2024-01-31 in microseconds.
NOW = 1_706_659_200_000_000

_TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
_TERMS = r"list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_-]+'), lambda t: length(t) >= 2 AND t NOT IN (" + ", ".join(f"'{w}'" for w in s.STOP) + ")))"


def _sql_stems() -> str:
    """CTEs from voc (x) to stem_of (x, stem): Porter's steps over the distinct words."""
    from tidelog.functions import stems as p

    test = lambda name, w: f"regexp_matches({w}, '{ {**p.MEASURE, 'vowel': p.VOWEL}[name]}')"
    short = lambda w: f"regexp_matches({w}, '^[^aeiou][^aeiouy]*[aeiouy][b-df-hj-np-tvz0-9]$')"
    less = lambda n: f"left(w, length(w) - {n})"

    def chain(rules, measure, more=lambda end, head: ""):
        ways = [f"WHEN ends_with(w, '{end}') THEN CASE WHEN {test(measure, less(len(end)))}{more(end, less(len(end)))} THEN {less(len(end))} || '{new}' ELSE w END" for end, new in sorted(rules, key=lambda r: -len(r[0]))]
        return f"CASE {' '.join(ways)} ELSE w END"

    ion = lambda end, head: f" AND right({head}, 1) IN ('s', 't')" if end == "ion" else ""
    steps = [
        "CASE WHEN left(x, 1) = 'y' THEN 'Y' || substr(x, 2) ELSE x END",
        f"CASE WHEN regexp_matches(w, '.(sses|ies)$') THEN {less(2)} WHEN ends_with(w, 'ss') OR NOT ends_with(w, 's') THEN w ELSE {less(1)} END",
        f"CASE WHEN ends_with(w, 'eed') AND w <> 'eed' THEN CASE WHEN {test('above0', less(3))} THEN {less(1)} ELSE w END WHEN ends_with(w, 'ed') AND {test('vowel', less(2))} THEN {less(2)} || '#' WHEN ends_with(w, 'ing') AND {test('vowel', less(3))} THEN {less(3)} || '#' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '#') THEN w WHEN regexp_matches(w, '(at|bl|iz)#$') THEN {less(1)} || 'e' WHEN lower(left(right(w, 3), 1)) = left(right(w, 2), 1) AND length(w) > 2 AND left(right(w, 2), 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') THEN {less(2)} WHEN {short(less(1))} THEN {less(1)} || 'e' ELSE {less(1)} END",
        f"CASE WHEN ends_with(w, 'y') AND {test('vowel', less(1))} THEN {less(1)} || 'i' ELSE w END",
        chain(p.STEP2, "above0"), chain(p.STEP3, "above0"), chain([(e, "") for e in (*p.STEP4, "ion")], "above1", ion),
        f"CASE WHEN ends_with(w, 'e') AND ({test('above1', less(1))} OR ({test('is1', less(1))} AND NOT {short(less(1))})) THEN {less(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {test('above1', 'w')} THEN {less(1)} ELSE w END",
    ]
    ctes = [f"v{i} AS (SELECT x, {step} AS w FROM {f'v{i - 1}' if i else 'voc'})" for i, step in enumerate(steps)]
    return ", ".join([*ctes, f"stem_of AS (SELECT x, CASE WHEN strlen(x) BETWEEN 3 AND 64 THEN CASE WHEN left(x, 1) = 'y' THEN 'y' || substr(w, 2) ELSE w END ELSE x END AS stem FROM v{len(steps) - 1})"])


_FOLDED = r"regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"


def _bm25(phrases: list[str], every: bool, name: str = "lex", text: str = "text") -> str:
    """CTEs ending in `name` (id, score): phrases of stems, words as rows with their places."""
    split = [p.split() for p in phrases]
    wanted = ", ".join(f"'{t}'" for t in dict.fromkeys(t for p in split for t in p))
    starts = lambda p: " JOIN ".join(["hit h0", *[f"hit h{j} ON h{j}.id = h0.id AND h{j}.pos = h0.pos + {j} AND h{j}.stem = '{t}'" for j, t in enumerate(p) if j]])
    counts = " UNION ALL ".join(f"SELECT h0.id, {i} AS p, count(*) AS t FROM {starts(p)} WHERE h0.stem = '{p[0]}' GROUP BY h0.id" for i, p in enumerate(split))
    return f"""wd AS (SELECT doc_id AS id, {_FOLDED.format(text)} AS w FROM documents), tk AS (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM wd),
    voc AS (SELECT DISTINCT x FROM tk), {_sql_stems()}, hit AS (SELECT id, pos, stem FROM tk JOIN stem_of USING (x) WHERE stem IN ({wanted})),
    tf AS ({counts}), df AS (SELECT p, count(*) AS d FROM tf GROUP BY p), whole AS (SELECT count(*) AS n, avg(len(w)) AS av FROM wd),
    {name} AS (SELECT id, sum(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * len(w) / av))) AS score FROM tf JOIN df USING (p) JOIN wd USING (id), whole
        GROUP BY id{f' HAVING count(*) = {len(phrases)}' if every else ''})"""


def docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def index(spark, sf):
    """The stored index of all documents."""
    return stored(docs(spark, sf).select("id", "text"), shared_folder(spark))


@query(f"WITH {_bm25(['the', 'that', 'with'], True)}, r AS (SELECT id, round(score, 6) AS score FROM lex) SELECT * FROM r ORDER BY score DESC, id LIMIT 50")
def bm25_search(spark, sf):
    found = index(spark, sf).hits(s.phrases("the that with"))
    return s.best(found.select("id", F.round("score", 6).alias("score")), 50)


@query(f"WITH {_bm25(['the', 'that', 'with'], True)}, r AS (SELECT id, round(score, 6) AS score FROM lex) SELECT * FROM r ORDER BY score DESC, id LIMIT 50")
def bm25_by_index(spark, sf):
    """The same question as bm25_search, over an index built for it alone."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    build(docs(spark, sf).select("id", "text"), folder)
    found = TextIndex(spark, folder).hits([["the"], ["that"], ["with"]])
    return s.best(found.select("id", F.round("score", 6).alias("score")), 50)


@query(f"WITH {_bm25(['the', 'that', 'with'], True)}, r AS (SELECT id, round(score, 6) AS score FROM lex) SELECT * FROM r ORDER BY score DESC, id LIMIT 50")
def bm25_by_scan(spark, sf):
    """The same question again, over the texts themselves."""
    found = s.bm25(docs(spark, sf), s.phrases("the that with"))
    return s.best(found.select("id", F.round("score", 6).alias("score")), 50)


@query(f"WITH {_bm25(['stupid', 'idiot', 'licens'], False)}, r AS (SELECT id, round(score, 6) AS score FROM lex) SELECT * FROM r ORDER BY score DESC, id LIMIT 50")
def bm25_alternatives(spark, sf):
    found = index(spark, sf).hits([["stupid"], ["idiot"], ["licensed"]], every=False)
    return s.best(found.select("id", F.round("score", 6).alias("score")), 50)


@query(f"WITH {_bm25(['under the apach', 'licens'], True)} SELECT id, round(score, 6) AS score FROM lex")
def phrase_search(spark, sf):
    return index(spark, sf).hits(s.phrases("under-the-apache licensing")).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25(['licens', 'pathet', 'zzqx'], False)}, r AS (SELECT id, round(score, 6) AS score, true AS relaxed FROM lex) SELECT * FROM r ORDER BY score DESC, id LIMIT 30")
def relaxed_lexical_fallback(spark, sf):
    found = s.relaxed_hits(index(spark, sf), "what is the licensed pathetic zzqx")
    return s.best(found.select("id", F.round("score", 6).alias("score"), "relaxed"), 30)


@query(f"WITH {_bm25(['etion', 'cion'], False)} SELECT id, round(score, 6) AS score FROM lex")
def folded_search(spark, sf):
    """Words with diacritics found by words without."""
    return index(spark, sf).hits([["etion"], ["cion"]], every=False).select("id", F.round("score", 6).alias("score"))


def _probe(spark, sf):
    """The query vector: that of the smallest id (one row)."""
    return [float(x) for x in table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


_VEC = "vs AS (SELECT vec_id AS id, label, round(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings)"


def vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return s.vector_scores(rows, _probe(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {_VEC} SELECT id, score FROM vs ORDER BY score DESC, id LIMIT 100")
def vector_search(spark, sf):
    return s.best(vectors(spark, sf), 100).select("id", "score")


@query(f"WITH {_VEC} SELECT id, score FROM vs WHERE label IN (1, 3) ORDER BY score DESC, id LIMIT 40")
def filtered_vector_search(spark, sf):
    return s.best(vectors(spark, sf).where(F.col("label").isin(1, 3)), 40).select("id", "score")


@query(f"WITH {_VEC}, p AS (SELECT id, floor(score * 20) AS score FROM vs ORDER BY vs.score DESC, id LIMIT 60) SELECT id, round(1.0 / rank() OVER (ORDER BY score DESC), 9)::DOUBLE AS rr FROM p")
def reciprocal_rank(spark, sf):
    pool = s.best(vectors(spark, sf), 60).select("id", F.floor(F.col("score") * 20).alias("score"))
    return s.reciprocal(pool, "score", "rr").select("id", F.round("rr", 9).alias("rr"))


@query(f"SELECT event_id AS id, round(exp(-ln(2) * greatest({NOW} - epoch_us(ts), 0) / 3600000000.0 / 24.0), 9) AS recency FROM events")
def recency_decay(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.round(s.recency(micros("ts"), NOW), 9).alias("recency"))


@query("SELECT page_id, CASE WHEN starts_with(lower(url), 'http://') OR starts_with(lower(url), 'https://') THEN 0.8::DOUBLE ELSE 0.68::DOUBLE END AS quality FROM pages")
def source_quality_prior(spark, sf):
    return table(spark, sf, "pages").select("page_id", source_quality(F.col("url"), F.lit(True)).cast("double").alias("quality"))


#: The flagship's question: its words are looked up as stems, its capitalised words as names.
QUESTION = "Who licensed this under the Apache License or the General Public License, stupid idiot"
_FUSE = f"""WITH {_bm25(['licens', 'thi', 'under', 'apach', 'licens', 'gener', 'public', 'stupid', 'idiot'], False)}, {_VEC},
sem AS (SELECT id, round(1.0 / rank() OVER (ORDER BY score DESC), 12) AS rs FROM (SELECT id, score FROM vs ORDER BY score DESC, id LIMIT 200)),
le AS (SELECT id, round(1.0 / rank() OVER (ORDER BY score DESC), 12) AS rl FROM (SELECT id, round(score, 6) AS score FROM lex ORDER BY round(score, 6) DESC, id LIMIT 200)),
f AS (SELECT doc_id AS id, exp(-ln(2) * ({NOW} - epoch_us(ts)) / 3600000000.0 / 240.0) AS recency, len(list_filter(list_distinct(regexp_extract_all(text, '{NAME}')), lambda x: x IN ('Who', 'Apache', 'Apache License', 'License', 'General', 'General Public', 'Public', 'Public License'))) AS mentions
  FROM documents JOIN events ON event_id = doc_id),
p AS (SELECT id, coalesce(rs, 0) AS rs, coalesce(rl, 0) AS rl, recency, coalesce(mentions, 0) AS mentions FROM (SELECT coalesce(sem.id, le.id) AS id, rs, rl FROM sem FULL JOIN le ON sem.id = le.id) JOIN f USING (id)),
q AS (SELECT *, CASE WHEN max(mentions) OVER () > 0 THEN mentions / max(mentions) OVER () ELSE 0 END AS ent FROM p)
SELECT id, round(0.4 * rs + 0.3 * rl + 0.1 * recency + 0.15 * ent + 0.05 * 0.68, 6) AS score FROM q ORDER BY round(0.4 * rs + 0.3 * rl + 0.1 * recency + 0.15 * ent + 0.05 * 0.68, 9) DESC, id LIMIT 10"""


@query(_FUSE)
def hybrid_recall(spark, sf):
    """The flagship: five arms over the stored index, vectors, names and times; no text is read."""
    known = index(spark, sf)
    lexical = known.hits([[t] for t in s.relaxed_terms(QUESTION)], every=False).select("id", F.round("score", 6).alias("score"))
    times = table(spark, sf, "events").select(F.col("event_id").alias("id"), s.recency(micros("ts"), NOW, 240.0).alias("recency"))
    pool = s.pooled(s.best(vectors(spark, sf), s.POOL).select("id", "score"), s.best(lexical, s.POOL))
    # Facts of the pool's rows only: the pool is broadcast to the times and to the names.
    pool = times.join(F.broadcast(docs(spark, sf).select("id").join(F.broadcast(pool), "id")), "id")  # moments have a document
    pool = pool.join(known.named(s.capitalised(QUESTION)), "id", "left")
    found = s.ranked(pool.withColumns({"mentions": F.coalesce("mentions", F.lit(0)), "source": F.lit(0.68)}), 10)
    return found.select("id", F.round("score", 6).alias("score"))


@query(f"""WITH c AS (SELECT item_id, {_TERMS.format('b.text')} AS q, {_TERMS.format('d.text')} AS e FROM benchmark b, (SELECT text FROM documents WHERE doc_id = 7) d)
SELECT item_id, CASE WHEN len(q) = 0 THEN 0 ELSE round(len(list_intersect(q, e)) / len(q)::DOUBLE, 9) END AS query_coverage, CASE WHEN len(e) = 0 THEN 0 ELSE round(len(list_intersect(q, e)) / len(e)::DOUBLE, 9) END AS document_coverage FROM c""")
def lexical_coverage(spark, sf):
    one = table(spark, sf, "documents").where("doc_id = 7").select(F.col("text").alias("e"))  # one row
    rows = table(spark, sf, "benchmark").join(F.broadcast(one))
    return rows.select("item_id", F.round(coverage(F.col("text"), F.col("e")), 9).alias("query_coverage"), F.round(coverage(F.col("e"), F.col("text")), 9).alias("document_coverage"))


@query(f"WITH {_VEC} SELECT id, label, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS scaled FROM vs WINDOW w AS (PARTITION BY label)")
def min_max_normalise(spark, sf):
    return s.min_max(vectors(spark, sf), "score", "scaled", "label").select("id", "label", F.round("scaled", 6).alias("scaled"))


@query(f"""WITH {_VEC}, c AS (SELECT vs.id, score AS cosine, {_TERMS.format("'the there than license'")} AS q, {_TERMS.format('text')} AS e FROM vs JOIN documents ON doc_id = vs.id ORDER BY score DESC, vs.id LIMIT 200),
d AS (SELECT id, cosine, q, e, len(list_intersect(q, e)) / len(q)::DOUBLE AS qc, CASE WHEN len(e) = 0 THEN 0 ELSE len(list_intersect(q, e)) / len(e)::DOUBLE END AS dc FROM c),
l AS (SELECT *, least(coalesce(list_max([length(t) FOR t IN e IF NOT list_contains(q, t)]), 0) / list_max([length(t) FOR t IN q])::DOUBLE, 1) AS nov FROM d ORDER BY qc DESC, dc DESC, id LIMIT 1), t AS (SELECT * FROM d ORDER BY cosine DESC, id LIMIT 1)
SELECT round(t.cosine, 6) AS cosine, round(greatest(t.cosine - (SELECT cosine FROM d ORDER BY cosine DESC, id LIMIT 1 OFFSET 1), 0), 6) AS margin, round(l.qc, 6) AS query_coverage, round(l.dc, 6) AS document_coverage,
(t.id = l.id)::INT::DOUBLE AS agreement, round(l.nov, 6) AS novelty FROM l, t""")
def evidence_features(spark, sf):
    c = vectors(spark, sf).join(docs(spark, sf), "id").select("id", F.col("score").alias("cosine"), "text")
    out = s.evidence_features(c, "the there than license")
    return out.select(*[F.round(x, 6).alias(x) if x != "agreement" else x for x in out.columns])


@query(f"""WITH {_bm25(['the', 'that'], False)} SELECT id, round(greatest(score, 0) * exp(-0.02 * 2.0 * ({NOW} - epoch_us(ts)) / 86400000000.0), 9) AS relevance FROM lex JOIN events ON event_id = id""")
def adjusted_relevance(spark, sf):
    found = index(spark, sf).hits([["the"], ["that"]], every=False)
    times = table(spark, sf, "events").select(F.col("event_id").alias("id"), micros("ts").alias("ts_us"))
    return found.join(times, "id").select("id", F.round(s.adjusted_relevance(F.col("score"), F.lit(0.02), F.lit(NOW) - F.col("ts_us")), 9).alias("relevance"))


@query()
def mmr(spark, sf):
    found = index(spark, sf).hits([["stupid"], ["licensed"]], every=False).join(docs(spark, sf), "id")
    pool = top_per_group(found, 24, ["source"], F.desc("score"), "id")
    pool = pool.select("source", "id", F.round("score", 6).alias("score"), long_words(F.col("text")).alias("words"))
    return s.diverse(pool, ["source"]).select("source", "id", "score", "place")


@query(f"""WITH {_VEC}, a AS (SELECT epoch_us(ts) AS t FROM events WHERE event_id = (SELECT id FROM vs ORDER BY score DESC, id LIMIT 1))
SELECT event_id AS id FROM events, a WHERE epoch_us(ts) BETWEEN t - 300000000 AND t + 300000000""")
def anchor_window(spark, sf):
    """Moments about the best vector hit of a question (the probe's own)."""
    anchor = s.best(vectors(spark, sf), 1).select("id")
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), micros("ts").alias("ts_us"))
    at = rows.join(F.broadcast(anchor), "id").select(F.col("ts_us").alias("t"))  # one row
    return rows.join(F.broadcast(at), F.col("ts_us").between(F.col("t") - s.ANCHOR, F.col("t") + s.ANCHOR)).select("id")


@query()
def restated_lines(spark, sf):
    """Pairs of texts of which one restates the other."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), long_words(F.col("text")).alias("words"))
    sets = packed(rows, 2)  # fewer words restate nothing
    return sharing(sets, sets, 0.6).where(restating("shared", "n_a", "n_b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")


@query(f"""WITH {_VEC}, h AS (SELECT id, score FROM vs ORDER BY score DESC, id LIMIT 20)
SELECT h.id, score, source, coalesce(quality, -1) AS quality, (SELECT count(*) FROM documents x WHERE x.source = d.source) AS same_source FROM h JOIN documents d ON d.doc_id = h.id LEFT JOIN labels l ON l.doc_id = h.id""")
def hit_enrichment(spark, sf):
    hits = s.best(vectors(spark, sf), 20).select("id", "score")
    d = docs(spark, sf).select("id", "source")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    counts = d.groupBy("source").agg(F.count("*").alias("same_source"))
    return hits.join(d, "id").join(labels, "id", "left").join(counts, "source").select("id", "score", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), "same_source")


@query(f"""SELECT doc_id, len({_TERMS.format('text')}) AS n_terms FROM documents""")
def content_term_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(content_terms(F.col("text"))).cast("long").alias("n_terms"))


_DAYS = "|".join(s.WEEKDAYS)


@query(f"""WITH q AS (SELECT conv_id, turn, lower(text) || [' yesterday', ' just before that', ' last friday', ' on monday', ' this evening', ''][turn % 6 + 1] AS t FROM conversations),
a AS (SELECT *, regexp_matches(t, '(right|just) (before|after) ') AS anchor FROM q),
r AS (SELECT *, CASE WHEN anchor THEN NULL WHEN contains(t, 'yesterday') THEN [2, 1] WHEN regexp_matches(t, 'this (morning|afternoon|evening)') THEN [1, 0]
  WHEN regexp_matches(t, 'last (week|{_DAYS})') THEN [14, 7] WHEN regexp_matches(t, '{_DAYS}') THEN [7, 0] END AS d FROM a)
SELECT conv_id, turn, CASE WHEN anchor THEN 'anchor' WHEN d IS NOT NULL THEN 'range' ELSE 'plain' END AS shape,
greatest({NOW} - coalesce(d[1], 99) * {s.DAY}, {NOW - 10 * s.DAY})::BIGINT AS "start", least({NOW} - coalesce(d[2], 0) * {s.DAY}, {NOW - s.DAY})::BIGINT AS "end" FROM r""")
def question_routes(spark, sf):
    """Shape and coarse range of each question, met with a filter of the ten days up to one day ago."""
    ends = F.element_at(F.array(*map(F.lit, (" yesterday", " just before that", " last friday", " on monday", " this evening", ""))), (F.col("turn") % 6 + 1).cast("int"))
    rows = table(spark, sf, "conversations").withColumn("text", F.concat("text", ends))
    out = s.routed(rows, NOW)
    return out.select("conv_id", "turn", "shape", F.greatest("start", F.lit(NOW - 10 * s.DAY)).alias("start"), F.least("end", F.lit(NOW - s.DAY)).alias("end"))


@query("""WITH q AS (SELECT n_nationkey AS id, 'What came from ' || upper(n_name) || ' then' AS text FROM nation), g AS (SELECT n_regionkey AS grp, n_name AS spelling FROM nation WHERE n_nationkey % 2 = 0)
SELECT DISTINCT q.id, o.spelling FROM q JOIN g ON contains(lower(q.text), lower(g.spelling)) JOIN g o ON o.grp = g.grp""")
def alias_expansion(spark, sf):
    nation = table(spark, sf, "nation")
    questions = nation.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("What came from "), F.upper("n_name"), F.lit(" then")).alias("text"))
    groups = nation.where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("group"), F.col("n_name").alias("spelling"))
    return s.expanded_rows(questions, groups)


@query(f"WITH {_bm25(['and', 'apach', 'licens', 'the', 'under'], False, text='concat_ws(chr(32), text, source)')}, r AS (SELECT id, round(score, 6) AS score FROM lex) SELECT * FROM r ORDER BY score DESC, id LIMIT 30")
def proposition_search(spark, sf):
    """Words of the question, over a proposition's text and reasoning."""
    rows = docs(spark, sf).select("id", "text", F.col("source").alias("reasoning"))
    found = s.propositions_about(rows, "under the Apache license, and")
    return s.best(found.select("id", F.round("score", 6).alias("score")), 30)
