"""Queries of extraction, redaction, addresses and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import urls
from tidelog.functions.text import changed_lines, cut, word_count
from tidelog.operators import extract as x
from tidelog.operators import store
from tidelog.plans.registry import query
from tidelog.sources.tables import table


def _nest(text: str, rules, make: str) -> str:
    for name, pattern in rules:
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(make.format(name))}, 'g')"
    return text


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SECRETS = "[" + ", ".join(f"CASE WHEN regexp_matches(text, {_q(p)}) THEN {_q(k)} END" for k, p in x.SECRETS) + "]"


@query(f"SELECT doc_id, array_to_string(list_filter({_SECRETS}, lambda k: k IS NOT NULL), ',') AS kinds FROM documents")
def secret_kinds(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(x.secret_kinds(F.col("text")), ",").alias("kinds"))


@query(f"SELECT doc_id, md5({_nest('text', x.SECRETS, '[REDACTED:{}]')}) AS digest FROM documents")
def secrets_masked(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(x.masked(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id FROM documents WHERE NOT ({' OR '.join(f'regexp_matches(text, {_q(p)})' for _, p in x.SECRETS)})")
def secret_refusal(spark, sf):
    return x.without_secrets(table(spark, sf, "documents"))[0].select("doc_id")


def _mentions_sql() -> str:
    site = "regexp_extract(v, '^([A-Za-z]+://[^/?#]*)', 1)"
    names = {"email": "lower(v)", "ipv6": "lower(v)", "bech32": "lower(v)", "uuid": "lower(v)", "ulid": "upper(v)"}
    names |= dict.fromkeys(("phone", "github_ref"), "regexp_replace(v, '[^0-9]', '', 'g')") | {"url": f"lower({site}) || substr(v, length({site}) + 1)"}
    cut = lambda t, before, pattern: rf"string_split_regex(regexp_replace({t}, {_q(f'({before})({pattern})')}, '\1' || chr(1) || '\2' || chr(2), 'g'), '[\x01\x02]')"
    blank = f"array_to_string(list_transform({cut('t', '', x.SECRET)}, lambda y, i: CASE WHEN i % 2 = 0 THEN repeat(' ', length(y)) ELSE y END), '')"
    secret, parts = {form for form, _ in x.SECRETS}, []
    for order, (kind, form, before, pattern) in enumerate(x.ENTITIES):
        value = f"regexp_replace(p[j], {_q(x.URL_END)}, '')" if form == "url" else "p[j]"
        name = _q(form) if kind == "redacted_token" else names.get(form, "v")
        pieces = cut("t" if form in secret else "u", before, pattern)
        pick = f"SELECT doc_id, coalesce(list_sum(list_transform(p[:j - 1], lambda y: length(y))), 0)::INT AS b, {value} AS v FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1, 2)) AS j FROM (SELECT doc_id, {pieces} AS p FROM d))"
        parts.append(f"SELECT doc_id, b, b + length(v) AS e, {order} AS o, {_q(kind)} AS kind, {name} AS name FROM ({pick})" + (" WHERE length(regexp_replace(v, '[^0-9]', '', 'g')) >= 10" if form == "phone" else ""))
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, t, {blank} AS u FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), a AS ({' UNION ALL '.join(parts)}),
    s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b, e, o) AS i FROM a),
    f(doc_id, i, reach, kind, name, kept) AS (SELECT doc_id, i, e, kind, name, true FROM s WHERE i = 1
    UNION ALL SELECT s.doc_id, s.i, CASE WHEN s.b >= f.reach THEN s.e ELSE f.reach END, s.kind, s.name, s.b >= f.reach FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1)
    SELECT doc_id, kind, name, count(*) AS n FROM f WHERE kept GROUP BY ALL"""


@query(_mentions_sql())
def entity_mentions(spark, sf):
    return x.mentions(table(spark, sf, "documents"), "doc_id")


#: Messages of which each turn of a conversation gets one, so that every rule has something to find.
_NOTICES = (
    "Chase Fraud Alert: Did you authorize $12.00? Reply YES or NO",
    "GitHub sign-in code for you: 482-910 today",
    "<#> 482910 is your code @example.com",
    "[#] 482910 is your OTP",
    "Authy: example.com - 728103",
    "passcode now 482-910",
    "Your verification code is 123-456",
    "029184 - your security code",
    "G-123456",
    "PIN: 7281034",
    "Use 728103 to complete",
    "382716 is your Meta security notice",
    "Click here to reset now",
    "We will never call to ask for it",
)


def _redaction_sql() -> str:
    made = " ".join(f"WHEN {i} THEN {_q(m)}" for i, m in enumerate(_NOTICES))
    ctes = [f"t0 AS (SELECT conv_id, turn, coalesce(text, '') || chr(10) || CASE turn % {len(_NOTICES)} {made} END AS t, []::VARCHAR[] AS r FROM conversations)"]
    for i, (rule, pattern) in enumerate(x.RULES):
        ctes.append(f"t{i + 1} AS MATERIALIZED (SELECT conv_id, turn, regexp_replace(t, {_q(pattern)}, {_q(x.rule_mark(rule))}, 'g') AS t, CASE WHEN regexp_matches(t, {_q(pattern)}) THEN list_append(r, {_q(rule)}) ELSE r END AS r FROM t{i})")
    return f"WITH {', '.join(ctes)} SELECT conv_id, turn, array_to_string(r, ',') AS rules, md5(t) AS digest FROM t{len(x.RULES)}"


@query(_redaction_sql())
def one_time_code_redaction(spark, sf):
    notice = F.element_at(F.array(*map(F.lit, _NOTICES)), (F.col("turn") % len(_NOTICES) + 1).cast("int"))
    rows = x.redacted(table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), notice).alias("text")))
    return rows.select("conv_id", "turn", F.array_join("rules", ",").alias("rules"), F.md5(F.col("text").cast("binary")).alias("digest"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"


@query(f"""SELECT page_id, {_HOST} AS host, {_HOST} || regexp_replace(CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) END, '/+$', '') AS address,
regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages""")
def url_parts(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.host(url).alias("host"), urls.address(url).alias("address"), urls.parameter(url, "page").alias("page"))


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), s AS (SELECT page_id, unnest([array_to_string(p[i:], '.') FOR i IN range(1, len(p) + 1)]) AS d FROM (SELECT page_id, string_split(host, '.') AS p FROM h))
SELECT DISTINCT page_id AS id FROM s WHERE d IN ('example.org', 'cheap-pills.example.com')""")
def sensitive_domains(spark, sf):
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("id"), urls.host(F.col("url")).alias("host"))
    domains = spark.createDataFrame([("example.org",), ("cheap-pills.example.com",)], "domain string")
    return x.on_domains(rows, domains).select("id")


@query("""SELECT user_id, 'google' AS engine, count(*) AS n, 'hello world ' || user_id AS query FROM events WHERE event_type = 'click' GROUP BY user_id""")
def search_query_parse(spark, sf):
    clicks = table(spark, sf, "events").where("event_type = 'click'").withColumn("url", F.concat(F.lit("https://www.google.co.uk/search?hl=en&q=hello+world%20"), F.col("user_id").cast("string")))
    found = clicks.select("user_id", urls.search_query(F.col("url")).alias("s"))
    return found.groupBy("user_id", F.col("s.engine").alias("engine"), F.col("s.query").alias("query")).agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT {_HOST} AS host, page_id FROM pages) SELECT host, count(*) AS pages, min(page_id) AS first_page, max(page_id) AS last_page FROM p GROUP BY host ORDER BY pages DESC, host LIMIT 24""")
def web_pages(spark, sf):
    rows = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host"), "page_id")
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page")).orderBy(F.desc("pages"), "host").limit(24)


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'suppress: denied app' WHEN (props::JSON ->> '$.k')::INT = 13 THEN 'suppress: denied site'
WHEN value IS NULL THEN 'suppress: unknown' WHEN value > 40 THEN 'suppress: private window' ELSE 'allow' END AS verdict FROM events""")
def suppression_cascade(spark, sf):
    rows = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    verdict = x.cascade((F.col("event_type") == "error", "suppress: denied app"), (k == 13, "suppress: denied site"), (F.col("value") > 40, "suppress: private window"))
    return rows.select("event_id", verdict.alias("verdict"))


@query("""SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 'no body' WHEN role = 'system' THEN 'denied' WHEN regexp_matches(text, 'https?://') THEN 'sensitive' ELSE 'allow' END AS verdict FROM conversations""")
def messages_cascade(spark, sf):
    text = F.coalesce("text", F.lit(""))
    verdict = x.cascade((text == "", "no body"), (F.col("role") == "system", "denied"), (text.rlike("https?://"), "sensitive"))
    return table(spark, sf, "conversations").select("conv_id", "turn", verdict.alias("verdict"))


@query("""SELECT s_suppkey, CASE WHEN s_name IS NULL THEN 'refuse' WHEN s_nationkey = 3 THEN 'header only' WHEN regexp_matches(s_name, '7$') THEN 'header only' ELSE 'allow' END AS verdict FROM supplier""")
def mail_header_cascade(spark, sf):
    verdict = x.cascade((F.col("s_name").isNull(), "refuse"), (F.col("s_nationkey") == 3, "header only"), (F.col("s_name").rlike("7$"), "header only"))
    return table(spark, sf, "supplier").select("s_suppkey", verdict.alias("verdict"))


_BLANK = r"[\s\v\x{85}\pZ]+"
_CHUNKS = rf"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, len(list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '')) AS words FROM documents),
p AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS k FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^{_BLANK}|{_BLANK}$', '', 'g')), lambda x: x <> '') AS ps FROM t WHERE words > 300)),
s AS (SELECT doc_id, k, unnest(ss) AS s, unnest(range(len(ss))) AS j FROM (SELECT doc_id, k, string_split(regexp_replace(p, '([.!?]){_BLANK}', '\1' || chr(1), 'g'), chr(1)) AS ss FROM p)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS i, len(list_filter(string_split_regex(s, '{_BLANK}'), lambda x: x <> '')) AS w FROM s),
f(doc_id, i, c, used, fresh) AS (SELECT doc_id, i, 0, w, true FROM o WHERE i = 1 UNION ALL
    SELECT o.doc_id, o.i, CASE WHEN f.used + o.w > 300 THEN f.c + 1 ELSE f.c END, CASE WHEN f.used + o.w > 300 THEN o.w ELSE f.used + o.w END, f.used + o.w > 300 FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1),
g AS (SELECT doc_id, c AS n, string_agg(CASE WHEN fresh THEN '' WHEN j = 0 THEN chr(10) || chr(10) ELSE ' ' END || s, '' ORDER BY i) AS chunk FROM f JOIN o USING (doc_id, i) GROUP BY doc_id, c)
SELECT doc_id, n, md5(chunk) AS digest FROM g UNION ALL SELECT doc_id, 0, md5(text) FROM t WHERE words BETWEEN 1 AND 300"""


@query(_CHUNKS)
def chunker(spark, sf):
    return x.chunks(table(spark, sf, "documents"), 300, "doc_id").select("doc_id", "n", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("""SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN '' ELSE md5('[app=' || role || ' | title=? | url=? | ts=' || turn || ']' || chr(10) || text) END AS digest FROM conversations""")
def context_header(spark, sf):
    none = F.lit(None).cast("string")
    full = x.context_header(F.col("role"), none, none, F.col("turn"), F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(full == "", "").otherwise(F.md5(full.cast("binary"))).alias("digest"))


@query(r"""WITH l AS (SELECT lang, doc_id, source, list_filter(string_split(coalesce(text, ''), chr(10)), lambda z: trim(z) <> '') AS a FROM documents),
e AS (SELECT lang, doc_id, source, unnest(list_distinct(list_concat(a[1:8], CASE WHEN len(a) > 8 THEN a[greatest(len(a) - 3, 9):] ELSE [] END))) AS line FROM l),
f AS (SELECT * FROM e WHERE len(regexp_split_to_array(trim(line), '\s+')) BETWEEN 2 AND 40), n AS (SELECT lang, count(DISTINCT doc_id) AS frames FROM documents GROUP BY lang)
SELECT lang, line FROM (SELECT lang, line, count(DISTINCT doc_id) AS seen, count(DISTINCT source) AS titles FROM f GROUP BY ALL) JOIN n USING (lang) WHERE seen * 20 >= frames AND titles >= 3""")
def repeated_chrome(spark, sf):
    """At a twentieth of the frames here: the test texts repeat lines more rarely than windows do."""
    return x.repeated_chrome(table(spark, sf, "documents"), ["lang"], "doc_id", "source", one_in=20)


@query(r"""WITH a AS (SELECT conv_id, turn, string_split(text, chr(10)) AS now, lag(string_split(text, chr(10))) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations)
SELECT conv_id, turn, CASE WHEN old IS NULL THEN len(list_filter(now, lambda z: trim(z) <> '' AND z <> '')) ELSE len(list_filter(now, lambda z: NOT list_contains(old, z) AND trim(z) <> '')) END AS changed FROM a""")
def changed_line_count(spark, sf):
    order = store.W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("old", F.lag("text").over(order))
    return rows.select("conv_id", "turn", changed_lines(F.col("text"), F.col("old")).cast("long").alias("changed"))


@query(r"SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ')) END AS n_tokens, CASE WHEN length(text) > 80 THEN left(text, 79) || '…' ELSE text END AS short FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", word_count(F.col("text")).cast("long").alias("n_tokens"), cut(F.col("text"), 80).alias("short"))


@query("""SELECT a.event_id, bit_count(xor(a.event_id * 2654435761, b.event_id * 2654435761))::INTEGER AS bits, CASE WHEN bit_count(xor(a.event_id * 2654435761, b.event_id * 2654435761)) <= 4 THEN 'drop'
WHEN bit_count(xor(a.event_id * 2654435761, b.event_id * 2654435761)) >= 12 THEN 'store' ELSE 'tie-break' END AS verdict FROM events a JOIN events b ON b.event_id = a.event_id + 1""")
def near_duplicate_frames(spark, sf):
    a = table(spark, sf, "events").select("event_id", (F.col("event_id") * 2654435761).alias("h"))
    b = a.select((F.col("event_id") - 1).alias("event_id"), F.col("h").alias("g"))
    bits = F.bit_count(F.col("h").bitwiseXOR(F.col("g")))
    return a.join(b, "event_id").select("event_id", bits.alias("bits"), x.picture_verdict(bits).alias("verdict"))


@query("""SELECT event_type, CASE event_type WHEN 'view' THEN 'research' WHEN 'click' THEN 'research' WHEN 'purchase' THEN 'planning' ELSE 'other' END AS kind, count(*) AS n FROM events WHERE event_type NOT IN ('signup') GROUP BY ALL""")
def work_kinds(spark, sf):
    catalogue = spark.createDataFrame([("view", "research"), ("click", "research"), ("purchase", "planning")], "event_type string, kind string")
    rows = table(spark, sf, "events").where(~F.lower("event_type").isin("signup"))
    joined = rows.join(F.broadcast(catalogue), "event_type", "left")  # a fixed catalogue
    return joined.groupBy("event_type", F.coalesce("kind", F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))
