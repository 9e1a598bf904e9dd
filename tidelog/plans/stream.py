"""Streaming queries: each drains the events as a stream and must equal the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.plans.registry import query
from tidelog.plans.timeline import REPEATS_SQL
from tidelog.operators.timeline import HOUR
from tidelog.sources.tables import micros, table
from tidelog.sources.transcripts import transcript_lines
from tidelog.streaming import ingest as s
from tidelog.streaming import stateful

#: No lateness: what comes late goes to a folder of its own.
NONE = "0 seconds"
KINDS = ["click", "view", "purchase", "signup", "error"]


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return s.table_files(spark, sf, "events", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def stream_validated_ingest(spark, sf):
    rows = s.split(s.valid(_events(spark, sf), KINDS[:3]), "ingest")
    return s.drained(s.once(rows.in_time).select("event_id", "event_type"), "once")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM m), a AS (SELECT user_id, epoch_us(min(ts)) AS begin_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, g)
SELECT * FROM a WHERE last_us + 43200000000 <= (SELECT epoch_us(max(ts)) FROM events)""")
def stream_sessions(spark, sf):
    """Sessions that are over at the watermark; an open one is not emitted in append mode."""
    out = s.drained(s.session_counts(s.split(_events(spark, sf), "in-time", late=NONE).in_time, "12 hours", ["user_id"], late=NONE), "sessions")
    return out.select("user_id", F.unix_micros("begin").alias("begin_us"), F.unix_micros("last").alias("last_us"), "n")


@query("""WITH c AS (SELECT event_type, ts FROM events), w AS (SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS begin_us, count(*) AS n FROM c GROUP BY ALL)
SELECT * FROM w WHERE begin_us + 3600000000 <= (SELECT epoch_us(max(ts)) FROM events)""")
def stream_hourly_counts(spark, sf):
    """Closed hours only: an open one is not emitted in append mode."""
    out = s.drained(s.slot_counts(s.split(_events(spark, sf), "in-time", late=NONE).in_time, "1 hour", ["event_type"], late=NONE), "hours")
    return out.select("event_type", F.unix_micros("begin").alias("begin_us"), "n")


@query("SELECT count(*) FILTER (WHERE event_type = 'error') AS refused, count(*) FILTER (WHERE event_type <> 'error') AS accepted FROM events")
def stream_dead_letter(spark, sf):
    good, bad = (s.shared_path(spark, x) for x in ("good", "bad"))
    rows = s.valid(_events(spark, sf), KINDS[:4])
    s.routed(rows, "routed", lambda b, n: b.write.mode("overwrite").parquet(f"{good}/batch={n}"), lambda b, n: b.write.mode("overwrite").parquet(f"{bad}/batch={n}"))
    counts = [spark.read.parquet(p).agg(F.count("*").alias(c)) for p, c in ((bad, "refused"), (good, "accepted"))]
    return counts[0].join(F.broadcast(counts[1]))  # one row each


@query(REPEATS_SQL)
def stream_repeats(spark, sf):
    """`repeat_suppression` as a stream: eight remembered rows a device."""
    rows = _events(spark, sf).select(F.col("event_id").alias("id"), micros("ts").alias("ts_us"), F.col("user_id").alias("device"), F.col("event_type").alias("app"))
    return s.drained(stateful.without_repeats(rows, "device", "app", 24 * HOUR), "repeats")


@query()
def stream_intervals(spark, sf):
    """Spans of two hours from every moment: those that meet an accepted one of their device are refused."""
    rows = _events(spark, sf).select(F.col("user_id").alias("device"), F.col("event_id").alias("id"), micros("ts").alias("start_us"))
    rows = rows.withColumn("end_us", F.col("start_us") + 2 * HOUR)
    day = 1_704_067_200_000_000 + 24 * HOUR
    return s.drained(stateful.appended(rows, "device", [(day, day + 6 * HOUR)], longest=2 * HOUR), "intervals")


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def stream_transcripts(spark, sf):
    """Conversations written as lines and read back by their source."""
    folder = s.shared_path(spark, "transcripts")
    rows = table(spark, sf, "conversations").repartition(4, "conv_id").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    rows.write.text(folder)
    lines = s.drained(transcript_lines(spark, folder, ".txt"), "lines")
    said = F.from_json("line", "conv_id long, turn long, role string, text string")
    return lines.select(said.alias("x")).select("x.conv_id", "x.turn", "x.role", F.md5(F.col("x.text").cast("binary")).alias("digest"))


@query("SELECT page_id, url, md5(html) AS digest FROM pages")
def exported_lines(spark, sf):
    """Pages exported as JSON lines, read back."""
    path, rows = s.shared_path(spark, "export"), table(spark, sf, "pages")
    s.export_lines(rows, path)
    return spark.read.schema(rows.schema).json(path).select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("digest"))
