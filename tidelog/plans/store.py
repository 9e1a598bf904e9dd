"""Queries of the store: scans, cursors, work queues, counts, set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators import store
from tidelog.plans.registry import query
from tidelog.sources.tables import MOMENTS_SQL as M
from tidelog.sources.tables import SOURCES_SQL as S
from tidelog.sources.tables import moments, sources, table

#: 2024-01-10 and 2024-01-12 in microseconds.
FROM, TO = 1_704_844_800_000_000, 1_705_017_600_000_000


@query(f"WITH {M} SELECT * FROM m ORDER BY ts_us DESC, id DESC LIMIT 50")
def recent_events(spark, sf):
    return store.newest(moments(spark, sf), 50)


@query(f"WITH {M} SELECT * FROM m WHERE ts_us BETWEEN {FROM} AND {TO} ORDER BY ts_us DESC, id DESC LIMIT 100")
def events_in_range(spark, sf):
    return store.newest(store.in_range(moments(spark, sf), FROM, TO), 100)


@query(f"WITH {M} SELECT * FROM m WHERE ts_us > {FROM} ORDER BY ts_us, id LIMIT 64")
def events_since(spark, sf):
    return store.since(moments(spark, sf), FROM, 64)


@query(f"WITH {M} SELECT * FROM m WHERE ts_us > {FROM} OR (ts_us = {FROM} AND id > 100) ORDER BY ts_us, id LIMIT 64")
def paged_events_since(spark, sf):
    return store.page_after(moments(spark, sf), FROM, 100, 64)


@query(f"WITH {M} SELECT * FROM m WHERE id > 500 ORDER BY id LIMIT 40")
def events_after_id(spark, sf):
    return store.after_id(moments(spark, sf), 500, 40)


@query("SELECT max(event_id) AS max_id FROM events")
def max_event_id(spark, sf):
    return moments(spark, sf).agg(F.max("id").alias("max_id"))


@query(f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts_us, id) AS rn, count(*) OVER (PARTITION BY device) AS n FROM m)
SELECT id, ts_us, app, device FROM r WHERE n <= 12 OR rn = 1 OR ((rn - 1) * 11) // greatest(n - 1, 1) > ((rn - 2) * 11) // greatest(n - 1, 1)""")
def sampled_events_between(spark, sf):
    return store.even_sample(moments(spark, sf), 12, "device").select("id", "ts_us", "app", "device")


@query(f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY ts_us, id) - 1 AS pos, count(*) OVER (PARTITION BY app) AS n FROM m)
SELECT id, ts_us, app FROM r WHERE n <= 9 OR pos IN (SELECT i * n // 9 FROM range(9) AS t(i))""")
def moments_of_app(spark, sf):
    return store.spread_pick(moments(spark, sf), 9, "app").select("id", "ts_us", "app")


@query(f"WITH {M} SELECT * FROM m WHERE app = 'error' ORDER BY ts_us DESC, id DESC LIMIT 30")
def events_by_app(spark, sf):
    return store.by_app(moments(spark, sf), "error", 30)


@query("SELECT page_id, url FROM pages WHERE url = 'https://www.ththhe.example.com/en' OR starts_with(url, 'https://www.ththhe.example.com/en/')")
def pages_by_url_prefix(spark, sf):
    return store.under_url(table(spark, sf, "pages").select("page_id", "url"), "https://www.ththhe.example.com/en/")


@query(f"WITH {M}, {S} SELECT m.*, kind FROM m JOIN src USING (id) WHERE kind = 'page' AND ts_us BETWEEN {FROM} AND {TO} ORDER BY ts_us DESC, id DESC LIMIT 50")
def events_by_source_in_range(spark, sf):
    rows = store.in_range(moments(spark, sf), FROM, TO)
    return store.newest(store.of_source(rows, sources(spark, sf), "page"), 50)


@query(f"WITH {M}, {S} SELECT id, ts_us, app, coalesce(kind, 'unknown') AS kind FROM m LEFT JOIN src USING (id) WHERE ts_us BETWEEN {FROM} AND {TO}")
def event_heads_in_range(spark, sf):
    heads = store.in_range(moments(spark, sf), FROM, TO).select("id", "ts_us", "app")
    return store.with_source(heads, sources(spark, sf))


@query(f"WITH {M} SELECT id, ts_us, app FROM m WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def event_heads_by_ids(spark, sf):
    ids = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return moments(spark, sf).select("id", "ts_us", "app").join(ids, "id", "left_semi")


@query(f"WITH {M} SELECT * FROM m WHERE ts_us BETWEEN {FROM} AND {TO} ORDER BY abs(ts_us - {FROM + 7_200_000_000}), ts_us, id LIMIT 5")
def keyframe_events_near(spark, sf):
    return store.nearest(store.in_range(moments(spark, sf), FROM, TO), FROM + 7_200_000_000, 5)


@query(f"WITH {M} SELECT id FROM m WHERE ts_us >= {FROM} AND ts_us <= {TO} AND app IN ('view', 'click') ORDER BY ts_us DESC, id DESC LIMIT 200")
def browse_event_ids_filtered(spark, sf):
    return store.newest(store.matching(moments(spark, sf), FROM, TO, apps=["view", "click"]), 200).select("id")


@query("SELECT doc_id AS id, text FROM documents WHERE doc_id = 8")
def event_text(spark, sf):
    return store.capped_text(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), 8)


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def unembedded_events(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return store.without(docs, table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


@query(f"WITH {M} SELECT * FROM m WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY ts_us DESC, id DESC LIMIT 80")
def moments_to_read(spark, sf):
    readings = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("version"))
    return store.unread(moments(spark, sf), readings, 1, 80)


@query(f"WITH {M} SELECT count(*) FILTER (WHERE quality = 1) AS current, count(*) FILTER (WHERE quality IS NULL) AS never FROM m LEFT JOIN labels ON doc_id = id")
def moment_reading_progress(spark, sf):
    readings = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("version"))
    return store.progress(moments(spark, sf), readings, 1)


@query("""SELECT c_custkey AS k, 'new' AS state, round(c_acctbal + 1, 2) AS v FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'old', round(c_acctbal, 2) FROM customer WHERE c_custkey % 3 <> 0""")
def put_replaces_by_key(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("state"), F.round("c_acctbal", 2).alias("v"))
    new = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("state"), F.round(F.col("c_acctbal") + 1, 2).alias("v"))
    return store.replaced(old, new, "k")


@query("""SELECT (SELECT count(*) FROM events) AS n_events, (SELECT epoch_us(min(ts)) FROM events) AS first_us, (SELECT epoch_us(max(ts)) FROM events) AS last_us,
(SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM conversations) AS n_turns""")
def stats(spark, sf):
    out = moments(spark, sf).agg(F.count("*").alias("n_events"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    for name, column in (("documents", "n_documents"), ("embeddings", "n_vectors"), ("conversations", "n_turns")):
        out = out.join(F.broadcast(table(spark, sf, name).agg(F.count("*").alias(column))))  # one row each
    return out


@query(f"""WITH {M}, {S} SELECT count(*) FILTER (WHERE kind IN ('screen', 'screen_context')) AS n_screen,
max(ts_us) FILTER (WHERE kind IN ('screen', 'screen_context')) AS last_screen_us, count(*) FILTER (WHERE kind = 'page') AS n_page FROM m JOIN src USING (id)""")
def capture_storage_stats(spark, sf):
    return store.storage_stats(moments(spark, sf).join(sources(spark, sf), "id"))


@query("SELECT event_type AS app, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, app LIMIT 24")
def observed_apps(spark, sf):
    return store.observed_apps(moments(spark, sf), 24)


@query("SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages")
def distinct_hosts(spark, sf):
    return table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host")).distinct()


@query("SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 40")
def recent_episodes(spark, sf):
    counts = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"))
    return counts.orderBy(F.desc("last_turn"), "conv_id").limit(40)


@query("SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, path LIMIT 30")
def file_paths_seen(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("path"), "l_orderkey")
    return store.distinct_per_key(rows, "path", "l_orderkey", 30)


@query("""SELECT l_orderkey AS event_id, count(*) AS n FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def mention_match_for_events(spark, sf):
    parts = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    hits = rows.join(parts, "l_partkey", "left_semi").join(orders, "l_orderkey", "left_semi")
    return hits.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS entities FROM (SELECT l_orderkey AS event_id, l_suppkey FROM lineitem)
GROUP BY event_id HAVING count(DISTINCT l_suppkey) >= 2""")
def entity_co_occurrence(spark, sf):
    mentions = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("entity_id"))
    return store.co_occurring(mentions).select("event_id", F.array_join(F.col("entities").cast("array<string>"), ",").alias("entities"))


@query("SELECT count(*) AS n, max(doc_id) AS last_id, sum(quality) AS quality_sum FROM labels")
def change_watermark(spark, sf):
    return table(spark, sf, "labels").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id"), F.sum("quality").alias("quality_sum"))


@query("""SELECT 'delete' AS action, doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)
UNION ALL SELECT 'insert', vec_id FROM embeddings WHERE label < 5 AND vec_id NOT IN (SELECT doc_id FROM labels)""")
def reconcile_by_id(spark, sf):
    stored = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    wanted = table(spark, sf, "embeddings").where("label < 5").select(F.col("vec_id").alias("id"))
    return store.reconcile(stored, wanted)


@query("SELECT user_id AS device, event_type AS app, max_by(event_id, struct_pack(t := ts, i := event_id)) AS id FROM events GROUP BY 1, 2")
def latest_by_key(spark, sf):
    return store.latest(moments(spark, sf), ["device", "app"], F.desc("ts_us"), F.desc("id")).select("device", "app", "id")


@query("""SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS rank FROM documents) WHERE rank <= 2""")
def top_n_per_group(spark, sf):
    return store.top_per_group(table(spark, sf, "documents"), 2, ["source"], F.desc("n_chars"), "doc_id").select("source", "doc_id", "rank")


@query("""WITH r AS (SELECT o_custkey AS key, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + 20 * 86400000000 AS e FROM orders),
a AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
b AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT key, min(s) AS "start", max(e) AS "end" FROM b GROUP BY key, island""")
def range_coalescing(spark, sf):
    day = 86_400_000_000
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), start.alias("start"), (start + 20 * day).alias("end"))
    return store.coalesced_ranges(rows, "key")


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS key, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + 20 * 86400000000 AS e FROM orders)
SELECT id, key FROM (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r) WHERE s < reach""")
def overlap_rejection(spark, sf):
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), start.alias("start"), (start + 20 * 86_400_000_000).alias("end"))
    return store.overlapping(rows, "key").select("id", "key")


@query("SELECT id FROM (SELECT doc_id AS id FROM labels WHERE toxic = 1 UNION SELECT vec_id FROM embeddings WHERE label = 3)")
def union_distinct(spark, sf):
    a = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return a.union(table(spark, sf, "embeddings").where("label = 3").select("vec_id")).distinct()


@query("SELECT min(doc_id) AS doc_id, source, lang FROM documents GROUP BY source, lang")
def first_wins_dedup(spark, sf):
    return store.latest(table(spark, sf, "documents"), ["source", "lang"], "doc_id").select("doc_id", "source", "lang")


@query("""SELECT c_custkey, c_name, n_name, coalesce(n, 0) AS n_orders FROM customer JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def threads_with_recipients(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(n, "c_custkey", "left").select("c_custkey", "c_name", "n_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*) AS n FROM conversations GROUP BY conv_id""")
def messages_with_participants(spark, sf):
    grouped = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("n"))
    return grouped


@query("""WITH b AS (SELECT min(doc_id) AS doc_id, md5(text) AS revision FROM documents GROUP BY md5(text)) SELECT * FROM b""")
def resources_by_revision(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("revision"))
    return rows.groupBy("revision").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "revision")
