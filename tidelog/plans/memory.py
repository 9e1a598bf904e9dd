"""Queries of the claim store, the graph, retention, evaluation and the user model, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.ids import hex_id, stable_id
from tidelog.functions.text import long_words, ngrams, tokens
from tidelog.operators import claims as c
from tidelog.operators import evaluate as e
from tidelog.operators import graph as g
from tidelog.operators import retention as r
from tidelog.operators import usermodel as u
from tidelog.plans.registry import query
from tidelog.sources.tables import micros, table

DAY = 86_400_000_000
#: 1998-01-01 and 1998-03-01 in microseconds.
VALID, ASSERTED = 883_612_800_000_000, 888_710_400_000_000
NOW = 1_706_659_200_000_000

_CLAIMS = f"""cl AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS predicate, o_orderstatus AS object, 'all' AS scope, epoch_us(o_orderdate) AS valid_from,
CASE WHEN o_orderkey % 3 = 0 THEN epoch_us(o_orderdate) + {90 * DAY} END AS valid_to, epoch_us(o_orderdate) + (o_orderkey % 10) * {DAY} AS asserted,
CASE WHEN o_orderkey % 7 = 0 THEN 'proposed' ELSE 'active' END AS status, (o_orderkey % 100) / 100.0::DOUBLE AS confidence FROM orders),
tr AS (SELECT l_linenumber::BIGINT AS id, l_orderkey AS claim, epoch_us(l_shipdate) AS effective, epoch_us(l_shipdate) + l_linenumber * {DAY} AS asserted,
CASE l_returnflag WHEN 'N' THEN 'active' WHEN 'R' THEN 'retracted' ELSE 'superseded' END AS status FROM lineitem),
kn AS (SELECT * FROM cl WHERE asserted <= {ASSERTED} AND valid_from <= {VALID} AND coalesce(valid_to, {VALID}) >= {VALID}),
la AS (SELECT claim, max_by(status, struct_pack(a := asserted, e := effective, i := id, s := status)) AS now FROM tr WHERE asserted <= {ASSERTED} AND effective <= {VALID} GROUP BY claim),
st AS (SELECT kn.* REPLACE (coalesce(now, status) AS status) FROM kn LEFT JOIN la ON claim = id)"""


def claims(spark, sf):
    at, key = micros("o_orderdate"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"), F.lit("all").alias("scope"),
        at.alias("valid_from"), F.when(key % 3 == 0, at + 90 * DAY).alias("valid_to"), (at + (key % 10) * DAY).alias("asserted"),
        F.when(key % 7 == 0, "proposed").otherwise("active").alias("status"), ((key % 100) / 100.0).alias("confidence"),
    )


def transitions(spark, sf):
    at, flag = micros("l_shipdate"), F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("long").alias("id"), F.col("l_orderkey").alias("claim"), at.alias("effective"), (at + F.col("l_linenumber") * DAY).alias("asserted"),
        F.when(flag == "N", "active").when(flag == "R", "retracted").otherwise("superseded").alias("status"),
    )


@query(f"WITH {_CLAIMS} SELECT id, subject, predicate, object FROM st WHERE status = 'active'")
def claims_as_of(spark, sf):
    return c.active_as_of(claims(spark, sf), transitions(spark, sf), VALID, ASSERTED).select("id", "subject", "predicate", "object")


@query(f"WITH {_CLAIMS} SELECT id, status FROM st")
def claim_status_as_of(spark, sf):
    return c.status_as_of(claims(spark, sf), transitions(spark, sf), VALID, ASSERTED).select("id", "status")


@query(f"""WITH {_CLAIMS} SELECT id AS claim, 0 AS step, asserted, valid_from AS effective, status FROM cl
UNION ALL SELECT claim, row_number() OVER (PARTITION BY claim ORDER BY asserted, effective, id, status)::INTEGER, asserted, effective, status FROM tr""")
def claim_history(spark, sf):
    return c.history(claims(spark, sf), transitions(spark, sf))


@query(f"SELECT DISTINCT l_orderkey AS claim, {ASSERTED}::BIGINT AS asserted, {ASSERTED}::BIGINT AS effective, 'retracted' AS status FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def claim_retractions(spark, sf):
    events = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("event"))
    evidence = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("event"))
    return c.retractions(events, evidence, ASSERTED).withColumns({"asserted": F.col("asserted").cast("long"), "effective": F.col("effective").cast("long")})


@query(f"""WITH {_CLAIMS}, a AS (SELECT id AS "by", valid_from AS effective, lag(id) OVER (PARTITION BY subject, predicate, scope ORDER BY valid_from, id) AS claim FROM cl WHERE status = 'active')
SELECT claim, "by", effective FROM a WHERE claim IS NOT NULL""")
def claim_supersessions(spark, sf):
    return c.supersessions(claims(spark, sf))


@query(f"""WITH {_CLAIMS}, n AS (SELECT subject, predicate, scope FROM cl GROUP BY ALL HAVING count(DISTINCT lower(trim(object))) = 1) SELECT id FROM cl JOIN n USING (subject, predicate, scope)""")
def claim_conflict_filter(spark, sf):
    return c.conflicts(claims(spark, sf))[0].select("id")


@query("""SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'insert' WHEN l.quality = 1 THEN 'same' ELSE 'conflict' END AS fate FROM documents d LEFT JOIN labels l USING (doc_id)""")
def claim_projection(spark, sf):
    deltas = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("payload"))
    return c.projected(deltas, table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("payload"))).select("id", "fate")


@query(f"""WITH RECURSIVE {_CLAIMS}, p AS (SELECT id, (subject % 40 + 1)::BIGINT AS n, row_number() OVER (ORDER BY confidence DESC, id) AS i FROM cl WHERE confidence >= 0.65 ORDER BY confidence DESC, id LIMIT 200),
f(i, used, id) AS (SELECT 0::BIGINT, 0::BIGINT, NULL::BIGINT UNION ALL SELECT p.i, CASE WHEN used + n <= 1200 THEN used + n ELSE used END, CASE WHEN used + n <= 1200 THEN p.id END FROM f JOIN p ON p.i = f.i + 1)
SELECT id, used FROM f WHERE id IS NOT NULL""")
def context_packet(spark, sf):
    rows = claims(spark, sf).withColumn("n_tokens", F.col("subject") % 40 + 1)
    return c.packet(rows, 200, 1200).select("id", "used")


@query(f"WITH {_CLAIMS} SELECT CASE WHEN contains(lower(predicate), 'urgent') THEN 'open loops' ELSE 'current state' END AS section, count(*) AS n FROM cl GROUP BY 1")
def packet_sections(spark, sf):
    return claims(spark, sf).groupBy(c.section(F.col("predicate")).alias("section")).agg(F.count("*").alias("n"))


#: What questions may bring along.
BUDGET = c.Budget(nodes=12, edges=14, evidence=5, tokens=60)


@query()
def memory_expansion(spark, sf):
    """Customers as requests, their orders as claims, documents as evidence of the items: what fits each budget."""
    seeds = table(spark, sf, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("claim"))
    n = table(spark, sf, "documents").agg(F.count("*").alias("n"))  # one row
    event = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("n")
    proof = table(spark, sf, "lineitem").join(F.broadcast(n)).select(F.col("l_orderkey").alias("claim"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("id"), event.alias("event")).distinct()
    events = table(spark, sf, "documents").select(F.col("doc_id").alias("event"), F.left("text", F.lit(300)).alias("text"), (F.col("doc_id") % 50).alias("episode"))
    mentions = table(spark, sf, "documents").select(F.col("doc_id").alias("event"), F.col("source").alias("entity")).where("entity is not null")
    identities = mentions.select("entity", F.upper("entity").alias("identity")).distinct()
    return c.expansion(seeds, proof, events, mentions, identities, BUDGET)


def _cut(spark):
    from tidelog.sources.tables import checkpointed

    return checkpointed(spark)


@query("""WITH RECURSIVE ed AS (SELECT p_partkey AS src, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS dst FROM part WHERE p_size > 5),
r(id) AS (SELECT p_partkey FROM part WHERE p_size = 50 UNION SELECT dst FROM r JOIN ed ON src = id) SELECT id FROM r""")
def deletion_closure(spark, sf):
    part = table(spark, sf, "part")
    n = part.count()
    edges = part.where("p_size > 5").select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % n).alias("dst"))
    return c.closure(part.where("p_size = 50").select(F.col("p_partkey").alias("id")), edges, _cut(spark), most=200)


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey - 1 END AS rf, CASE WHEN c_custkey % 5 = 0 THEN 'active' ELSE 'revised' END AS state FROM customer),
n AS (SELECT rf AS id, max_by(id, struct_pack(a := state = 'active', i := id)) AS nx FROM p WHERE rf IS NOT NULL GROUP BY rf),
w(id, z) AS (SELECT id, id FROM p UNION ALL SELECT w.id, nx FROM w JOIN n ON n.id = w.z)
SELECT id, max(z) AS newest FROM w GROUP BY id""")
def newest_revision(spark, sf):
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(key.alias("id"), F.when(key % 4 != 0, key - 1).alias("revised_from"), F.when(key % 5 == 0, "active").otherwise("revised").alias("state"))
    return u.newest_revision(rows, _cut(spark))


@query("""WITH ed AS (SELECT o_custkey AS src, o_custkey % 97 AS dst FROM orders), b AS (SELECT src AS node, dst AS other FROM ed UNION ALL SELECT dst, src FROM ed)
SELECT DISTINCT node, other FROM b WHERE node IN (SELECT s_suppkey FROM supplier)""")
def episode_neighbours(spark, sf):
    edges = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") % 97).alias("dst"))
    return g.neighbours(edges, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")))


@query("""WITH l AS (SELECT l_orderkey AS ep, l_suppkey AS i, epoch_us(l_shipdate) AS t FROM lineitem),
p AS (SELECT DISTINCT least(a.ep, b.ep) AS src, greatest(a.ep, b.ep) AS dst, a.i, greatest(a.t, b.t) AS t FROM l a JOIN l b ON a.i = b.i AND a.ep < b.ep AND abs(a.t - b.t) <= 86400000000)
SELECT src, dst, array_to_string(list_sort(list(DISTINCT i)), ',') AS evidence, max(t) AS ts_us FROM p GROUP BY src, dst""")
def episode_consolidation(spark, sf):
    from tidelog.operators.timeline import near_pairs

    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("identity"), micros("l_shipdate").alias("ts_us"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("episode"))
    pairs = near_pairs(rows, "identity", DAY, "episode").select("identity", "episode_a", "episode_b", F.col("ts_us_a").alias("ts_a"), F.col("ts_us_b").alias("ts_b"))
    return g.consolidated(pairs).select("src", "dst", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"), "ts_us")


@query("""WITH m AS (SELECT c_custkey AS member, c_nationkey AS ident FROM customer), s AS (SELECT ident FROM m GROUP BY ident HAVING count(*) >= 2)
SELECT ident AS identity, member FROM m WHERE ident IN (SELECT ident FROM s)""")
def identity_members(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("identity"))
    large = rows.groupBy("identity").agg(F.count("*").alias("n")).where("n >= 2")
    return rows.join(large, "identity", "left_semi").select("identity", "member")


@query(r"""SELECT c_custkey AS id, substr(sha256('entity' || chr(0) || c_name), 1, 32) AS digest, lower(printf('%016x', c_custkey)) AS hex FROM customer""")
def deterministic_ids(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.substring(F.sha2(F.concat_ws("\u0000", F.lit("entity"), "c_name"), 256), 1, 32).alias("digest"), hex_id(F.col("c_custkey")).alias("hex"))


@query()
def ulid_shaped_ids(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), stable_id(F.lit("entity"), F.col("c_name")).alias("ulid"))


@query(f"SELECT event_id AS id FROM events WHERE epoch_us(ts) >= {NOW - 7 * DAY}")
def retention_survivors(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), micros("ts").alias("ts_us"))
    return r.surviving(rows, NOW, 7).select("id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def deletion_cascade(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return r.cascade(table(spark, sf, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_episodes(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return r.orphans(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey")


def pictures(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), micros("ts").alias("ts_us"), F.col("event_type").alias("window"), F.get_json_object("props", "$.k").cast("int").alias("changed"),
        F.md5(F.get_json_object("props", "$.k").cast("binary")).alias("digest"), (F.length("event_type") * 1000).cast("long").alias("bytes"), F.col("user_id").alias("device"), (F.col("event_id") % 3 == 0).alias("is_front"),
    )


_PIC = "pc AS (SELECT event_id AS id, epoch_us(ts) AS ts_us, event_type AS win, (props::JSON ->> '$.k')::INT AS changed, md5(props::JSON ->> '$.k') AS digest, (length(event_type) * 1000)::BIGINT AS bytes, user_id AS device, event_id % 3 = 0 AS is_front FROM events)"


@query(f"""WITH {_PIC}, b AS (SELECT *, CASE WHEN {NOW} - ts_us < {DAY} THEN 0 WHEN {NOW} - ts_us < {7 * DAY} THEN 900000000 WHEN {NOW} - ts_us < {30 * DAY} THEN 7200000000 ELSE {DAY} END AS w FROM pc),
k AS (SELECT *, CASE WHEN w = 0 THEN id ELSE ts_us // w END AS b FROM b) SELECT id FROM k QUALIFY row_number() OVER (PARTITION BY win, w, b ORDER BY changed DESC, ts_us DESC, id DESC) = 1""")
def picture_thinning(spark, sf):
    return r.thinned(pictures(spark, sf), NOW).select("id")


@query(f"""WITH {_PIC}, s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY device, digest ORDER BY ts_us DESC, id DESC) = 1 THEN bytes ELSE 0 END AS sz, ts_us // {DAY} AS day FROM pc),
d AS (SELECT device, day, sum(sz) AS total FROM s GROUP BY ALL), z AS (SELECT device, day, sum(total) OVER (PARTITION BY device ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS used FROM d)
SELECT s.id FROM s JOIN z USING (device, day) WHERE used * 10 <= 100000 * 9""")
def picture_budget(spark, sf):
    return r.within_budget(pictures(spark, sf), 100_000).select("id")


@query(f"WITH {_PIC}, o AS (SELECT digest, bool_or(is_front) AS front, max(bytes) AS bytes FROM pc GROUP BY digest) SELECT front, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM o GROUP BY front")
def picture_usage(spark, sf):
    return r.picture_usage(pictures(spark, sf))


@query(f"WITH {_PIC} SELECT DISTINCT digest FROM pc WHERE digest NOT IN (SELECT digest FROM pc WHERE ts_us >= {NOW - DAY} AND is_front)")
def unreferenced_blobs(spark, sf):
    p = pictures(spark, sf)
    return r.orphans(p.select("digest").distinct(), p.where((F.col("ts_us") >= NOW - DAY) & F.col("is_front")), "digest")


_HITS = """hits AS (SELECT l_suppkey AS query, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank, l_partkey AS id FROM lineitem QUALIFY rank <= 20),
rel AS (SELECT DISTINCT l_suppkey AS query, l_partkey AS id FROM lineitem WHERE l_quantity > 45),
x AS (SELECT query, count(*) AS n FROM rel GROUP BY 1), f AS (SELECT query, count(*) FILTER (WHERE rank <= 5) AS in_k, min(rank) AS first FROM hits JOIN rel USING (query, id) GROUP BY 1),
sc AS (SELECT query, coalesce(in_k, 0) / 5.0::DOUBLE AS precision, coalesce(in_k, 0) / n::DOUBLE AS recall, (coalesce(in_k, 0) > 0)::INT AS hit, coalesce(1.0::DOUBLE / first, 0) AS rr FROM x LEFT JOIN f USING (query))"""


def _ranked(spark, sf):
    rows = table(spark, sf, "lineitem")
    order = F.row_number().over(e.W.partitionBy("query").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    hits = rows.select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("id"), "l_extendedprice", "l_orderkey", "l_linenumber").withColumn("rank", order).where("rank <= 20")
    relevant = rows.where("l_quantity > 45").select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("id"))
    return e.ranked_scores(hits.select("query", "rank", "id"), relevant, 5)


@query(f"WITH {_HITS} SELECT query, round(precision, 6) AS precision, round(recall, 6) AS recall, hit, round(rr, 6) AS rr FROM sc")
def retrieval_scores(spark, sf):
    return _ranked(spark, sf).select("query", *[F.round(x, 6).alias(x) for x in ("precision", "recall")], "hit", F.round("rr", 6).alias("rr"))


@query(f"""WITH {_HITS}, k AS (SELECT *, query % 4 <> 0 AS a, rr > 0.3 AS ans FROM sc)
SELECT count(*) FILTER (WHERE a) AS answerable, count(*) FILTER (WHERE NOT a) AS unanswerable, round(avg(hit) FILTER (WHERE a), 6) AS hit, round(avg(recall) FILTER (WHERE a), 6) AS recall, round(avg(rr) FILTER (WHERE a), 6) AS mrr,
round(avg(ans::INT) FILTER (WHERE NOT a), 6) AS fpr, round(avg(hit) FILTER (WHERE a) - avg(ans::INT) FILTER (WHERE NOT a), 6) AS separation FROM k""")
def retrieval_summary(spark, sf):
    cases = _ranked(spark, sf).withColumns({"answerable": F.col("query") % 4 != 0, "answered": F.col("rr") > 0.3})
    out = e.summary(cases)
    return out.select("answerable", "unanswerable", *[F.round(x, 6).alias(x) for x in ("hit", "recall", "mrr", "fpr", "separation")])


@query("""WITH g AS (SELECT event_type AS k, value AS s, count(*) FILTER (WHERE user_id % 2 = 0) AS p, count(*) FILTER (WHERE user_id % 2 = 1) AS n FROM events GROUP BY 1, 2),
w AS (SELECT k, s, lead(s) OVER o AS nx, sum(p) OVER (o ROWS UNBOUNDED PRECEDING) AS pb, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS nb, sum(p) OVER (PARTITION BY k) AS pt, sum(n) OVER (PARTITION BY k) AS nt FROM g WINDOW o AS (PARTITION BY k ORDER BY s)),
j AS (SELECT k, (s + nx) / 2 AS threshold, round((pt - pb)::DOUBLE / pt - (nt - nb)::DOUBLE / nt, 9) AS youden FROM w WHERE nx IS NOT NULL AND pt > 0 AND nt > 0)
SELECT k AS event_type, threshold, youden FROM j QUALIFY row_number() OVER (PARTITION BY k ORDER BY youden DESC, threshold) = 1""")
def abstention_threshold(spark, sf):
    samples = table(spark, sf, "events").select("event_type", F.col("value").alias("score"), (F.col("user_id") % 2 == 0).alias("positive"))
    return e.abstention_threshold(samples, "event_type")


@query("""WITH m AS (SELECT event_type AS name, avg(value) AS value FROM events GROUP BY 1 UNION ALL SELECT 'documents', count(*)::DOUBLE FROM documents),
b(name, least, most) AS (VALUES ('click', 5.0, 100.0), ('documents', 10.0, NULL), ('view', NULL, 1.0), ('missing', 0.0, NULL))
SELECT b.name, round(value, 6) AS value, coalesce(value >= coalesce(least, value) AND value <= coalesce(most, value), false) AS passed FROM b LEFT JOIN m USING (name)""")
def quality_gate(spark, sf):
    metrics = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    metrics = metrics.union(table(spark, sf, "documents").select(F.lit("documents").alias("name")).groupBy("name").agg(F.count("*").cast("double").alias("value")))
    bounds = spark.createDataFrame([("click", 5.0, 100.0), ("documents", 10.0, None), ("view", None, 1.0), ("missing", 0.0, None)], "name string, least double, most double")
    return e.gate(metrics, bounds).withColumn("value", F.round("value", 6))


@query("""WITH g AS (SELECT l_orderkey AS doc, l_returnflag AS kind, l_partkey AS b FROM lineitem WHERE l_linenumber <= 3), f AS (SELECT l_orderkey AS doc, l_returnflag AS kind, l_partkey AS b FROM lineitem WHERE l_linenumber >= 2),
u AS (SELECT doc, kind, b, max(s = 1) AS g, max(s = 2) AS f FROM (SELECT *, 1 AS s FROM g UNION ALL SELECT *, 2 FROM f) GROUP BY ALL),
n AS (SELECT doc, count(*) FILTER (WHERE g) AS ng, count(*) FILTER (WHERE f) AS nf, count(*) FILTER (WHERE g AND f) AS nb FROM u GROUP BY doc),
p AS (SELECT doc, CASE WHEN nf = 0 THEN (ng = 0)::INT::DOUBLE ELSE nb / nf::DOUBLE END AS p, CASE WHEN ng = 0 THEN (nf = 0)::INT::DOUBLE ELSE nb / ng::DOUBLE END AS r FROM n)
SELECT doc, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM p""")
def span_scores(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("begin"), (F.col("l_partkey") + 1).alias("end"), "l_linenumber")
    out = e.span_scores(rows.where("l_linenumber <= 3"), rows.where("l_linenumber >= 2"))
    return out.select("doc", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query(r"""WITH d AS (SELECT doc_id AS id, text FROM documents), f AS (SELECT doc_id AS id, source AS fact FROM documents UNION ALL SELECT doc_id, 'the' FROM documents)
SELECT d.id, contains(lower(text), 'stupid')::INT + contains(lower(text), 'idiot')::INT AS forbidden, 0 AS citations, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS words,
len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) BETWEEN 20 AND 400 AS fits, c.coverage FROM d JOIN (SELECT d.id, avg(contains(lower(text), lower(fact))::INT) AS coverage FROM d JOIN f USING (id) GROUP BY d.id) c USING (id)""")
def digest_scores(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    facts = d.select("id", F.col("source").alias("fact")).union(d.select("id", F.lit("the")))
    return e.digest_scores(d.select("id", "text"), facts, ["stupid", "idiot"], 20, 400).withColumn("words", F.col("words").cast("long"))


@query(f"SELECT event_id AS id, greatest({NOW} - epoch_us(ts), 0) >= CASE WHEN value >= 9 THEN 1 WHEN value >= 7 THEN 7 ELSE 45 END * {DAY} AND value >= 4 AS stale FROM events")
def proposition_staleness(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), u.stale(F.col("value") / 10, micros("ts"), F.lit(NOW)).alias("stale"))


@query("""SELECT o_custkey AS subject, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, epoch_us(o_orderdate) DESC, o_orderkey) <= 3""")
def servable_propositions(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("confidence"), micros("o_orderdate").alias("updated_us"), F.when(F.col("o_orderstatus") == "F", "active").alias("state"))
    return u.servable(rows, "subject", 3).select("subject", "id")


@query("""WITH x AS (SELECT l_suppkey AS id, avg(l_discount) > 0.05 AS sure, l_suppkey % 11 = 0 AS sens, l_suppkey % 13 = 0 AS forg, l_suppkey % 5 AS nw, l_suppkey % 7 = 0 AS ol, count(DISTINCT l_orderkey) AS nm, count(DISTINCT l_shipdate) AS nd FROM lineitem GROUP BY 1)
SELECT id, CASE WHEN NOT sure THEN 'not sure' WHEN sens THEN 'sensitive' WHEN forg THEN 'forgotten' WHEN nw < 2 THEN 'too plain' WHEN ol THEN 'only names and labels' WHEN nm < 3 THEN 'too few moments' WHEN nd < 2 THEN 'one day' END AS held FROM x""")
def sending_gate(spark, sf):
    key = F.col("l_suppkey")
    rows = table(spark, sf, "lineitem").groupBy(key.alias("id")).agg(u.mean_over("l_discount", "0.05").alias("sure"), F.countDistinct("l_orderkey").alias("n_moments"), F.countDistinct("l_shipdate").alias("n_days"))
    key = F.col("id")
    rows = rows.withColumns({"sensitive": key % 11 == 0, "forgotten": key % 13 == 0, "n_words": key % 5, "only_labels": key % 7 == 0})
    return u.sending_gate(rows).select("id", "held")


@query("""WITH v AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS i, l_partkey % 50 AS p FROM lineitem), pg AS (SELECT p, count(DISTINCT s) AS al FROM v GROUP BY p),
rare AS (SELECT * FROM pg WHERE NOT ((SELECT count(DISTINCT s) FROM v) >= 10 AND al > (SELECT count(DISTINCT s) FROM v) * 0.4)), w AS (SELECT i, p, count(DISTINCT s) AS wi FROM v GROUP BY i, p)
SELECT i AS l_suppkey, p AS page, floor(wi * 1000 / greatest(al, wi, 1))::BIGINT AS score FROM w JOIN rare USING (p)""")
def seen_together(spark, sf):
    visits = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_partkey") % 50).alias("page"))
    return u.together(visits, "l_orderkey", "l_suppkey", "page")


@query(f"SELECT event_id AS id FROM events WHERE epoch_us(ts) >= {NOW - 48 * 3_600_000_000} ORDER BY ts DESC, id DESC LIMIT 4")
def recent_work(spark, sf):
    return u.recent_work(table(spark, sf, "events").select(F.col("event_id").alias("id"), micros("ts").alias("ts_us")), NOW, hours=48).select("id")


@query()
def proposition_integration(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("topic"), long_words(F.col("text")).alias("words"))
    return u.integrated(rows.where("id % 3 = 0"), rows.where("id % 3 = 1"), rows.where("id % 3 = 2")).select("id", "fate", "into")


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
n AS (SELECT doc_id, list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM t)
SELECT doc_id, list_has_any(g, ['idiot', 'gnu general', 'medical record']) AS sensitive FROM n""")
def sensitive_areas(spark, sf):
    words = table(spark, sf, "documents").withColumn("w", tokens(F.col("text")))
    terms = F.array(*map(F.lit, ("idiot", "gnu general", "medical record")))
    return words.select("doc_id", F.arrays_overlap(F.concat("w", ngrams(F.col("w"), 2)), terms).alias("sensitive"))
