"""Queries of work items, digests, transcripts and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import urls
from tidelog.operators import search, store
from tidelog.operators import work as w
from tidelog.plans.registry import query
from tidelog.sources.tables import MOMENTS_SQL as M
from tidelog.sources.tables import micros, moments, table

DAY = 86_400_000_000


@query("""WITH t AS (SELECT l_orderkey, l_suppkey, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL) SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, l_suppkey) = 1""")
def main_item(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return w.main_item(rows, "l_orderkey", "l_suppkey", "q")


@query(f"""WITH {M}, p AS (SELECT device, app, sum(k)::BIGINT AS us, count(*) AS n FROM m GROUP BY ALL), q AS (SELECT *, CASE WHEN sum(us) OVER (PARTITION BY device) > 0 THEN us ELSE n END AS wt FROM p)
SELECT device, app FROM q QUALIFY row_number() OVER (PARTITION BY device ORDER BY wt DESC, list_position(['view', 'click', 'purchase', 'signup', 'error'], app)) = 1""")
def kind_of_session(spark, sf):
    return w.main_kind(moments(spark, sf), "device", "app", "k", ["view", "click", "purchase", "signup", "error"])


@query(r"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^(.*)/[^/]*$', 1) AS folder, page_id % 7 + 1 AS wt FROM pages),
t AS (SELECT host, folder, sum(wt)::BIGINT AS weight FROM p WHERE folder <> '' GROUP BY ALL) SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY host ORDER BY weight DESC, length(folder), folder) = 1""")
def folder_guess(spark, sf):
    rows = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"), (F.col("page_id") % 7 + 1).alias("wt"))
    return w.folder_guess(rows, "host", "path", "wt")


@query(f"""WITH {M}, h AS (SELECT app, ts_us // {DAY} AS day, k FROM m), d AS (SELECT day, dense_rank() OVER (ORDER BY day DESC) AS back FROM (SELECT DISTINCT day FROM h))
SELECT app, sum(k)::BIGINT AS total, sum(CASE WHEN back <= 14 THEN k ELSE 0 END)::BIGINT AS last_14, sum(CASE WHEN back <= 7 THEN k ELSE 0 END)::BIGINT AS last_7, count(DISTINCT day) AS days FROM h JOIN d USING (day) GROUP BY app HAVING sum(k) >= 30""")
def active_day_totals(spark, sf):
    return w.active_days(moments(spark, sf).withColumn("day", F.floor(F.col("ts_us") / DAY)), "app", "day", "k", 30)


@query(r"""WITH l AS (SELECT source, doc_id AS id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
t AS (SELECT source, id, pos, trim(raw) AS line, len(regexp_split_to_array(trim(raw), '\s+')) AS words FROM l), u AS (SELECT * FROM t WHERE words BETWEEN 4 AND 40 QUALIFY row_number() OVER (PARTITION BY source, line ORDER BY id, pos) = 1),
s AS (SELECT *, CASE WHEN regexp_matches(lower(line), 'decided|decision|agreed|approved|chose') THEN 'decisions' WHEN regexp_matches(lower(line), 'todo|follow up|blocked|waiting|question|next step') THEN 'open loops' WHEN regexp_matches(lower(line), 'merged|released|shipped|deployed|fixed|done') THEN 'shipped' ELSE 'notes' END AS section FROM u),
g AS (SELECT *, (section <> 'notes')::INT * 100 + least(words, 20) AS weight FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY source, section ORDER BY weight DESC, id, pos) AS i FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN i = 1 THEN 0 ELSE 1 END, weight DESC, id, pos)::INTEGER AS place FROM f)
SELECT source, place, section, id, line || ' [event:' || id || ']' AS line FROM p WHERE place <= 9""")
def extractive_digest(spark, sf):
    return w.digest(table(spark, sf, "documents").select("source", F.col("doc_id").alias("id"), "text"), ["source"])


@query(f"WITH {M}, r AS (SELECT id, app, row_number() OVER (PARTITION BY app ORDER BY ts_us DESC, id DESC)::INTEGER AS turn FROM m) SELECT * FROM r ORDER BY turn, app LIMIT 17")
def round_robin_evidence(spark, sf):
    return w.round_robin(moments(spark, sf), "app", 17).select("id", "app", "turn")


@query("""WITH t AS (SELECT user_id, event_id AS pos, CASE event_type WHEN 'click' THEN 'B-PER' WHEN 'view' THEN 'I-PER' WHEN 'signup' THEN 'I-ORG' WHEN 'error' THEN 'B-MISC' ELSE 'O' END AS tag, event_id::VARCHAR AS word FROM events),
q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS pos, tag, word FROM t), k AS (SELECT *, regexp_extract(tag, '^[BI]-(.*)$', 1) AS kind, tag LIKE 'B-%' AS b FROM q),
n AS (SELECT *, (b OR kind <> lag(kind) OVER (PARTITION BY user_id ORDER BY pos) OR lag(kind) OVER (PARTITION BY user_id ORDER BY pos) IS NULL)::INT AS nw FROM k), r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM n)
SELECT user_id, kind, min(pos) AS "begin", max(pos) AS "end", string_agg(word, ' ' ORDER BY pos) AS name, 1.0::DOUBLE AS score FROM r WHERE kind IN ('PER', 'ORG', 'LOC') GROUP BY user_id, run, kind""")
def tagged_names(spark, sf):
    kinds = F.create_map(*[F.lit(v) for v in ("click", "B-PER", "view", "I-PER", "signup", "I-ORG", "error", "B-MISC")])
    rows = table(spark, sf, "events").select("user_id", F.row_number().over(store.W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("pos"), F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("O")).alias("tag"), F.col("event_id").cast("string").alias("word"), F.lit(1.0).alias("score"))
    return w.merged_tags(rows, ["user_id"])


@query("""WITH RECURSIVE s AS (SELECT l_suppkey AS doc, epoch_us(l_shipdate) // 86400000000 AS b, epoch_us(l_shipdate) // 86400000000 + l_linenumber * 20 AS e, l_orderkey * 10 + l_linenumber AS i FROM lineitem),
t AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY b, e) AS rn FROM (SELECT doc, b, e FROM s GROUP BY ALL)),
f(doc, rn, b, e, reach, kept) AS (SELECT doc, rn, b, e, e, true FROM t WHERE rn = 1 UNION ALL SELECT t.doc, t.rn, t.b, t.e, CASE WHEN t.b >= f.reach THEN t.e ELSE f.reach END, t.b >= f.reach FROM f JOIN t ON t.doc = f.doc AND t.rn = f.rn + 1)
SELECT doc, b AS "begin", e AS "end" FROM f WHERE kept""")
def overlap_resolution(spark, sf):
    day = F.floor(micros("l_shipdate") / DAY)
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), day.alias("begin"), (day + F.col("l_linenumber") * 20).alias("end")).distinct()
    return w.without_overlaps(rows, ["doc"])


@query("""WITH l AS (SELECT l_orderkey AS frame, l_linenumber AS line, l_partkey % 100 AS x, l_suppkey % 100 AS y FROM lineitem),
v AS (SELECT o_orderkey + d AS frame, o_custkey AS win, o_orderkey % 5 + d AS z, o_custkey % 40 AS a, o_custkey % 30 AS b FROM orders, range(3) AS t(d))
SELECT frame, line, win AS "window" FROM (SELECT * FROM l JOIN v USING (frame) WHERE x BETWEEN a AND a + 60 AND y BETWEEN b AND b + 60) QUALIFY row_number() OVER (PARTITION BY frame, line ORDER BY z, win) = 1""")
def window_attribution(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 100).alias("y"))
    own = table(spark, sf, "orders").withColumn("d", F.explode(F.array(*map(F.lit, range(3)))))
    left, top = F.col("o_custkey") % 40, F.col("o_custkey") % 30
    windows = own.select((F.col("o_orderkey") + F.col("d")).alias("frame"), F.col("o_custkey").alias("window"), (F.col("o_orderkey") % 5 + F.col("d")).alias("z"), left.alias("left"), top.alias("top"), (left + 60).alias("right"), (top + 60).alias("bottom"))
    return w.windows_of_lines(lines, windows)


@query("""WITH v AS (SELECT o_orderkey AS seq, o_custkey AS id, o_orderstatus AS verdict FROM orders), n AS (SELECT c_custkey AS id, c_custkey - c_custkey % 3 AS newest FROM customer WHERE c_custkey % 5 <> 0)
SELECT newest AS target, max_by(verdict, seq) AS verdict FROM v JOIN n USING (id) GROUP BY newest""")
def verdict_inbox(spark, sf):
    key = F.col("c_custkey")
    newest = table(spark, sf, "customer").where(key % 5 != 0).select(key.alias("id"), (key - key % 3).alias("newest"))
    verdicts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("verdict"))
    return w.applied_verdicts(verdicts, newest)


@query("""WITH n AS (SELECT l_orderkey AS packet, count(*) AS n, count(DISTINCT l_returnflag) AS sc, count(DISTINCT (l_partkey, l_linenumber)) AS df FROM lineitem GROUP BY 1)
SELECT packet, n, CASE WHEN n > 8 THEN 'too many' WHEN sc > 1 THEN 'scopes differ' WHEN df < n THEN 'duplicate' END AS problem FROM n""")
def evidence_binding(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("packet"), F.col("l_partkey").alias("event"), F.col("l_linenumber").alias("begin"), F.col("l_linenumber").alias("end"), F.col("l_returnflag").alias("scope"))
    return w.bound_evidence(rows)


@query("""SELECT conv_id AS session, min_by(text, turn) FILTER (WHERE role = 'user') AS goal, max_by(text, turn) AS stopped, max_by(role, turn) AS "by", count(*) AS turns FROM conversations GROUP BY conv_id""")
def transcript_project_state(spark, sf):
    return w.project_state(table(spark, sf, "conversations").withColumnRenamed("conv_id", "session"))


@query(r"""WITH l AS (SELECT conv_id, turn, regexp_replace(text, chr(10), ' ', 'g') AS line FROM conversations), u AS (SELECT *, sum(len(regexp_split_to_array(trim(line), '\s+'))) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS used FROM l),
f AS (SELECT conv_id, string_agg('- ' || line, chr(10) ORDER BY turn) AS markdown, max(used) AS tokens FROM u WHERE used <= 400 GROUP BY conv_id) SELECT *, sha256(markdown) AS digest FROM f""")
def handoff_render(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", "\n", " ").alias("line"))
    return w.render(rows, ["conv_id"], "line", "turn", 400)


@query("""WITH d AS (SELECT doc_id, text, greatest(coalesce(nullif(strpos(lower(text), 'licensed'), 0), 1) - 80, 1) AS b FROM documents)
SELECT doc_id, CASE WHEN b > 1 THEN '…' ELSE '' END || substr(text, b, 160) || CASE WHEN b + 160 <= length(text) THEN '…' ELSE '' END AS passage FROM d""")
def excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", search.excerpt(F.col("text"), ["licensed"]).alias("passage"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&amp;', '&', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS reading,
regexp_extract(html, '<title>([^<]*)</title>', 1) AS caption FROM pages""")
def page_reading(spark, sf):
    """Page texts without markup; scripts whose own text holds a tag keep their rest, as in the SQL."""
    html = F.col("html")
    bare = F.regexp_replace(html, r"<(script|style)[^>]*>[^<]*</(script|style)>", " ")
    for pattern, to in ((r"<[^>]*>", " "), ("&amp;", "&"), (r"[ \t\n\x0B\f\r]+", " ")):
        bare = F.regexp_replace(bare, pattern, to)
    return table(spark, sf, "pages").select("page_id", F.trim(bare).alias("reading"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("caption"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, host || ': ' || CASE WHEN length(title) > 40 THEN left(title, 39) || '…' ELSE title END AS subject FROM t""")
def window_subject(spark, sf):
    from tidelog.functions.text import cut

    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", F.concat(urls.host(F.col("url")), F.lit(": "), cut(title, 40)).alias("subject"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(line, '^[ ]*([-*•]|[0-9]+[.)]) ') THEN 'list' WHEN regexp_matches(line, '^(>|&gt;)') THEN 'quote' WHEN regexp_matches(line, '( \| ).*( \| )') THEN 'table'
WHEN regexp_matches(line, '[{};]$') THEN 'code' WHEN regexp_matches(line, '^[^a-z]*[A-Z]{3,}[^a-z]*$') THEN 'shout' ELSE 'paragraph' END AS block, count(*) AS n FROM l GROUP BY ALL""")
def reading_blocks(spark, sf):
    line = F.col("line")
    block = (
        F.when(F.trim(line) == "", "blank").when(line.rlike("^#{1,6} "), "heading").when(line.rlike(r"^[ ]*([-*•]|[0-9]+[.)]) "), "list").when(line.rlike("^(>|&gt;)"), "quote")
        .when(line.rlike(r"( \| ).*( \| )"), "table").when(line.rlike("[{};]$"), "code").when(line.rlike("^[^a-z]*[A-Z]{3,}[^a-z]*$"), "shout").otherwise("paragraph")
    )
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("doc_id", block.alias("block")).agg(F.count("*").alias("n"))
