"""Queries of the time engine.  Test moments are sparse, so gaps are hours here."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import timeline as t
from tidelog.plans.registry import query
from tidelog.sources.tables import MOMENTS_SQL as M
from tidelog.sources.tables import SOURCES_SQL as S
from tidelog.sources.tables import moments, sources, table

HOUR, DAY = t.HOUR, t.DAY
FROM, TO = 1_704_844_800_000_000, 1_705_017_600_000_000

_FOCUS = "coalesce(kind, 'unknown') NOT IN ('screen_context', 'transcript_import', 'mcp_resource')"
_LAST = "last_value({} IGNORE NULLS) OVER (PARTITION BY device ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {M}, {S}, a AS (SELECT m.*, {_FOCUS} AS f FROM m LEFT JOIN src USING (id)),
b AS (SELECT *, {_LAST.format("CASE WHEN f THEN ts_us END")} AS lt, {_LAST.format("CASE WHEN f THEN app END")} AS la, row_number() OVER (PARTITION BY device ORDER BY ts_us, id) AS rn FROM a),
c AS (SELECT *, ((f AND (lt IS NULL OR app IS DISTINCT FROM la OR ts_us - lt > {24 * HOUR})) OR (NOT f AND rn = 1))::INT AS n FROM b)
SELECT id, device, sum(n) OVER (PARTITION BY device ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM c""")
def episode_segmentation(spark, sf):
    rows = moments(spark, sf).join(sources(spark, sf), "id", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    return t.episodes(rows, 24 * HOUR, is_focus=~F.col("kind").isin(*t.NOT_FOCUS)).select("id", "device", "episode")


@query(f"""WITH RECURSIVE {M}, r AS (SELECT id, ts_us, device, row_number() OVER (PARTITION BY device ORDER BY ts_us, id) AS rn FROM m),
s(id, ts_us, device, rn, began, session) AS (SELECT id, ts_us, device, rn, ts_us, 1::BIGINT FROM r WHERE rn = 1
UNION ALL SELECT r.id, r.ts_us, r.device, r.rn, CASE WHEN r.ts_us - s.ts_us >= {12 * HOUR} OR r.ts_us - s.began >= {48 * HOUR} THEN r.ts_us ELSE s.began END,
s.session + CASE WHEN r.ts_us - s.ts_us >= {12 * HOUR} OR r.ts_us - s.began >= {48 * HOUR} THEN 1 ELSE 0 END FROM s JOIN r ON r.device = s.device AND r.rn = s.rn + 1)
SELECT id, device, session FROM s""")
def session_split(spark, sf):
    return t.sessions(moments(spark, sf), 12 * HOUR, 48 * HOUR).select("id", "device", F.col("session").cast("long").alias("session"))


@query(f"""WITH {M}, a AS (SELECT *, CASE WHEN lag(id) OVER w IS NULL OR app IS DISTINCT FROM lag(app) OVER w THEN 1 ELSE 0 END AS n FROM m WINDOW w AS (PARTITION BY device ORDER BY ts_us, id)),
b AS (SELECT *, sum(n) OVER (PARTITION BY device ORDER BY ts_us, id ROWS UNBOUNDED PRECEDING) AS g FROM a),
c AS (SELECT device, app, g, min(ts_us) AS start_us, max(ts_us) AS last_us, count(*) AS n FROM b GROUP BY device, app, g)
SELECT device, app, start_us, n, coalesce(lead(start_us) OVER (PARTITION BY device ORDER BY g), last_us) AS end_us FROM c""")
def segments(spark, sf):
    return t.spans(moments(spark, sf), ["device"], ["app"])


_HELD = f"h AS (SELECT *, coalesce(least(lead(ts_us) OVER (PARTITION BY device ORDER BY ts_us, id) - ts_us, {2 * t.MINUTE}), 0) AS held_us FROM m)"


@query(f"WITH {M}, {_HELD} SELECT id, held_us FROM h")
def span_estimate(spark, sf):
    return t.held(moments(spark, sf)).select("id", "held_us")


@query(f"""WITH {M}, {_HELD}, d AS (SELECT device, ts_us // {DAY} AS day, app, sum(held_us)::BIGINT AS app_us FROM h GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY device, day ORDER BY app_us DESC, app)::INTEGER AS rank FROM d QUALIFY rank <= 12""")
def day_breakdown(spark, sf):
    return t.day_breakdown(moments(spark, sf))


@query(f"""WITH {M}, {_HELD}, d AS (SELECT device, ts_us // {DAY} AS day, (ts_us % {DAY} // {HOUR})::INTEGER AS hour, app, sum(held_us)::BIGINT AS held_us FROM h GROUP BY ALL)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY device, day, hour ORDER BY held_us DESC, app) = 1""")
def day_top_per_hour(spark, sf):
    return t.top_per_hour(moments(spark, sf))


@query(f"""WITH {M}, {_HELD}, c AS (SELECT *, coalesce(lag(app) OVER (PARTITION BY device ORDER BY ts_us, id) <> app, false)::INT AS ch FROM h)
SELECT device, ts_us // {DAY} AS day, sum(ch)::BIGINT AS switches, sum(held_us)::BIGINT AS active_us, round(sum(ch) / greatest(sum(held_us) / {HOUR}, 0.25), 6) AS per_hour FROM c GROUP BY ALL""")
def app_switches(spark, sf):
    return t.switches(moments(spark, sf))


@query(f"""WITH {M}, a AS (SELECT device, app AS a, lead(app, 1) OVER w AS b, lead(app, 2) OVER w AS c FROM m WINDOW w AS (PARTITION BY device ORDER BY ts_us, id))
SELECT device, least(a, b) AS "left", greatest(a, b) AS "right", count(*) + 1 AS times FROM a WHERE a = c AND a <> b GROUP BY ALL HAVING count(*) + 1 >= 3""")
def back_and_forth(spark, sf):
    return t.back_and_forth(moments(spark, sf))


@query(f"""WITH {M}, h AS (SELECT *, coalesce(least(lead(ts_us) OVER (PARTITION BY user ORDER BY ts_us, id) - ts_us, {2 * HOUR}), 0) AS held_us FROM (SELECT *, device % 5 AS user FROM m)),
p AS (SELECT user, ts_us // {HOUR} AS slot, app, sum(held_us)::BIGINT AS us FROM h GROUP BY ALL),
s AS (SELECT user, slot, sum(us)::BIGINT AS total, max_by(app, struct_pack(u := us, a := app)) AS kind FROM p GROUP BY ALL),
g AS (SELECT * FROM s WHERE total * 2 >= {HOUR}),
i AS (SELECT *, CASE WHEN slot = lag(slot) OVER w + 1 AND kind = lag(kind) OVER w THEN 0 ELSE 1 END AS n FROM g WINDOW w AS (PARTITION BY user ORDER BY slot)),
j AS (SELECT *, sum(n) OVER (PARTITION BY user ORDER BY slot) AS k FROM i)
SELECT user AS device, kind, min(slot) AS first_slot, count(*) AS slots, sum(total)::BIGINT AS active_us FROM j GROUP BY user, k, kind HAVING count(*) >= 2""")
def focus_blocks(spark, sf):
    rows = moments(spark, sf).withColumn("device", F.col("device") % 5)
    return t.focus_blocks(rows, slot=HOUR, least=2, cap=2 * HOUR)


@query("""WITH g AS (SELECT l_suppkey, sum(l_quantity)::BIGINT AS ks, count(*) AS c, sum(l_linenumber)::BIGINT AS s, count(DISTINCT l_orderkey) / 4.0 AS mi FROM lineitem GROUP BY 1),
m AS (SELECT *, greatest(mi, 0.25) AS t FROM g)
SELECT l_suppkey, CASE WHEN ks / t >= 25 THEN 'typing' WHEN s / t >= 3 AND ks / t < 10 THEN 'reading' WHEN c / t >= 4 AND ks / t < 10 THEN 'clicking' WHEN ks > 0 THEN 'typing a little' ELSE 'looking' END AS activity FROM m""")
def segment_activity(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("k"), F.count("*").alias("c"), F.sum("l_linenumber").alias("s"), (F.countDistinct("l_orderkey") / 4.0).alias("m"))
    return g.select("l_suppkey", t.activity_label(F.col("k"), F.col("c"), F.col("s"), F.col("m")).alias("activity"))


@query(f"""WITH {M}, l AS (SELECT * FROM m WHERE app = 'purchase'), r AS (SELECT device, ts_us, k FROM m WHERE app = 'view'),
j AS (SELECT l.id, l.device, l.ts_us, r.k, r.ts_us AS rt FROM l ASOF LEFT JOIN r ON l.device = r.device AND l.ts_us >= r.ts_us)
SELECT id, device, CASE WHEN ts_us - rt <= {6 * HOUR} THEN k END AS seen FROM j""")
def newest_screenshot_as_of(spark, sf):
    m = moments(spark, sf)
    right = m.where("app = 'view'").select("device", "ts_us", F.col("k").alias("seen"))
    return t.as_of(m.where("app = 'purchase'").select("id", "device", "ts_us"), right, "device", "seen", 6 * HOUR).select("id", "device", "seen")


@query(f"""WITH {M}, i AS (SELECT device, id AS iid, ts_us AS start_us, ts_us + {3 * HOUR} AS end_us FROM m WHERE app = 'signup')
SELECT m.id, iid FROM m JOIN i ON m.device = i.device AND m.ts_us >= i.start_us AND m.ts_us < greatest(i.end_us, i.start_us + 1) WHERE m.app = 'click'""")
def counts_in_segment(spark, sf):
    m = moments(spark, sf)
    intervals = m.where("app = 'signup'").select("device", F.col("id").alias("iid"), F.col("ts_us").alias("start_us"), (F.col("ts_us") + 3 * HOUR).alias("end_us"))
    return t.points_in_intervals(m.where("app = 'click'").select("id", "device", "ts_us"), intervals, "device", 3 * HOUR).select("id", "iid")


@query(f"""WITH {M} SELECT a.id AS id_a, b.id AS id_b FROM m a JOIN m b ON a.device = b.device AND (a.ts_us, a.id) < (b.ts_us, b.id) AND b.ts_us - a.ts_us <= {2 * HOUR} AND a.app <> b.app""")
def near_in_time_pairs(spark, sf):
    return t.near_pairs(moments(spark, sf), "device", 2 * HOUR, "app").select("id_a", "id_b")


#: Row by row: what was kept lately goes along as a list.
REPEATS_SQL = f"""WITH RECURSIVE {M}, o AS (SELECT id, ts_us, device, app, row_number() OVER (PARTITION BY device ORDER BY ts_us, id) AS i FROM m),
f(device, i, kept, taken) AS (SELECT device, 0::BIGINT, []::STRUCT(t BIGINT, x VARCHAR)[], false FROM (SELECT DISTINCT device FROM o) UNION ALL
    SELECT device, i, CASE WHEN new THEN list_append(kept, {{'t': ts_us, 'x': lower(app)}})[-8:] ELSE kept END, new FROM (
        SELECT f.device, o.i, f.kept, o.ts_us, o.app, len(list_filter(f.kept, lambda k: k.x = lower(o.app) AND o.ts_us - k.t < {24 * HOUR})) = 0 AS new FROM f JOIN o ON o.device = f.device AND o.i = f.i + 1))
SELECT o.id, o.ts_us, o.device, o.app FROM f JOIN o ON o.device = f.device AND o.i = f.i WHERE taken"""


@query(REPEATS_SQL)
def repeat_suppression(spark, sf):
    rows = moments(spark, sf).select("id", "ts_us", "device", "app")
    return t.collapsed_repeats(rows, "device", "app", within=24 * HOUR)


@query(f"""WITH {M}, a AS (SELECT *, lag(k) OVER (PARTITION BY device ORDER BY ts_us, id) AS p FROM m)
SELECT device, sum(CASE WHEN p IS NULL THEN 0 WHEN k < p THEN k ELSE k - p END)::BIGINT AS growth, sum(coalesce(k < p, false)::INT)::BIGINT AS restarts FROM a GROUP BY device""")
def health_summary(spark, sf):
    return t.health(moments(spark, sf), "k")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(value) AS least, max(value) FILTER (WHERE i = ((n - 1) * 50 + 50) // 100) AS p50, max(value) FILTER (WHERE i = ((n - 1) * 95 + 50) // 100) AS p95,
max(value) AS most, round(avg(value), 6) AS mean FROM r GROUP BY 1""")
def distribution_stats(spark, sf):
    return t.distribution(table(spark, sf, "events"), "value", "event_type")


@query(f"""WITH {M}, b AS (SELECT *, (ts_us - {FROM}) // {(TO - FROM) // 16} AS bucket FROM m WHERE ts_us BETWEEN {FROM} AND {TO})
SELECT id, device, bucket FROM b QUALIFY row_number() OVER (PARTITION BY device, bucket ORDER BY CASE WHEN k > 50 THEN 0 ELSE 1 END, ts_us, id) = 1""")
def timeline_downsample(spark, sf):
    return t.downsampled(moments(spark, sf), 16, FROM, TO, preferred=F.col("k") > 50).select("id", "device", "bucket")


@query(f"""WITH {M}, g AS (SELECT *, coalesce(least(lead(ts_us) OVER (PARTITION BY device, app ORDER BY ts_us, id) - ts_us, {t.MINUTE}), {30 * t.SECOND}) AS us FROM m)
SELECT app, ts_us // {DAY} AS day, sum(us)::BIGINT AS screen_us FROM g GROUP BY ALL""")
def screen_totals(spark, sf):
    m = moments(spark, sf).withColumn("key", F.struct("device", "app"))
    timed = t.held(m, cap=t.MINUTE, tail=30 * t.SECOND, device="key")
    return timed.groupBy("app", t.local_day().alias("day")).agg(F.sum("held_us").alias("screen_us"))


@query(f"""WITH {M}, h AS (SELECT *, ts_us // {DAY} AS day FROM m)
SELECT app, count(*) AS moments, count(DISTINCT day) AS days, max(ts_us) AS last_us, count(DISTINCT device) AS devices,
count(*) FILTER (WHERE day > (SELECT max(day) - 14 FROM h)) AS recent_14, count(*) FILTER (WHERE day > (SELECT max(day) - 7 FROM h)) AS recent_7 FROM h GROUP BY app""")
def work_items(spark, sf):
    m = moments(spark, sf).withColumn("day", t.local_day())
    last = m.agg(F.max("day").alias("last_day"))  # one row
    rows = m.join(F.broadcast(last))
    return rows.groupBy("app").agg(
        F.count("*").alias("moments"), F.countDistinct("day").alias("days"), F.max("ts_us").alias("last_us"), F.countDistinct("device").alias("devices"),
        F.count_if(F.col("day") > F.col("last_day") - 14).alias("recent_14"), F.count_if(F.col("day") > F.col("last_day") - 7).alias("recent_7"),
    )


@query(f"""WITH {M}, sp AS (SELECT id, device, app, ts_us FROM m WHERE k % 5 = 0), f AS (SELECT device, app, ts_us, k FROM m WHERE k % 5 <> 0),
j AS (SELECT sp.id, sp.app, sp.ts_us, f.k, f.ts_us AS ft FROM sp ASOF LEFT JOIN f ON sp.device = f.device AND sp.app = f.app AND sp.ts_us + 5000000 >= f.ts_us)
SELECT id, CASE WHEN app <> 'view' THEN app WHEN ts_us - ft < 900000000 THEN 'page ' || k ELSE 'view' END AS kind FROM j""")
def kind_of_span(spark, sf):
    """A span's kind: that of its application or, for research, of the page last seen there up to 5 s after its start, under 15 min old."""
    m = moments(spark, sf)
    key = F.concat_ws("/", "device", "app").alias("key")
    spans = m.where("k % 5 = 0").select("id", "app", key, F.col("ts_us").alias("start_us"), (F.col("ts_us") + 5_000_000).alias("ts_us"))
    pages = m.where("k % 5 <> 0").select(key, "ts_us", F.concat(F.lit("page "), F.col("k")).alias("page"))
    seen = t.as_of(spans, pages, "key", "page", 15 * t.MINUTE + 5_000_000 - 1)
    return seen.select("id", F.when(F.col("app") == "view", F.coalesce("page", F.lit("view"))).otherwise(F.col("app")).alias("kind"))


@query(f"""WITH {M}, s AS (SELECT device, id AS item, ts_us - {10 * 60_000_000} AS a, ts_us + {HOUR} + {10 * 60_000_000} AS b FROM m WHERE app = 'signup')
SELECT s.item, m.id FROM s JOIN m ON m.device = s.device AND m.ts_us >= s.a AND m.ts_us < s.b WHERE m.id <> s.item""")
def near_items(spark, sf):
    """Moments within ten minutes of an item's span, which here lasts an hour."""
    m = moments(spark, sf)
    near = 10 * t.MINUTE
    spans = m.where("app = 'signup'").select("device", F.col("id").alias("item"), (F.col("ts_us") - near).alias("start_us"), (F.col("ts_us") + HOUR + near).alias("end_us"))
    found = t.points_in_intervals(m.select("device", "id", "ts_us"), spans, "device", HOUR)
    return found.where("id <> item").select("item", "id")
