"""Streams over one file, many unordered files and folders of parts: nothing is lost unsaid."""

import os
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidelog import plans
from tidelog.plans.stream import KINDS, NONE
from tidelog.sources.tables import table
from tidelog.streaming import ingest, stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """The events as a folder of 40 files, the older half last."""
    root = tmp_path_factory.mktemp("sf")
    rows = table(spark, SF, "events").toPandas().sort_values("ts")
    half = len(rows) // 2
    os.mkdir(f"{root}/events.parquet")
    for i in range(40):
        part = (rows[half:] if i < 20 else rows[:half]).iloc[i % 20 :: 20]
        part.to_parquet(f"{root}/events.parquet/part-{i:03d}.parquet", coerce_timestamps="us", index=False)
        os.utime(f"{root}/events.parquet/part-{i:03d}.parquet", (1_700_000_000 + i,) * 2)
    return str(root)


def split(spark, sf, late, per_batch=8):
    schema = table(spark, sf, "events").schema
    rows = ingest.table_files(spark, sf, "events", schema, per_batch).withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.split(ingest.valid(rows, KINDS[:3]), "test", late=late)


@pytest.mark.parametrize("late", [NONE, "10 minutes", "400 days"])
def test_accepted_late_and_refused_rows_are_all_rows(spark, scattered, late):
    found = split(spark, scattered, late)
    whole = {r.event_id for r in table(spark, SF, "events").collect()}
    once = {r.event_id for r in ingest.drained(ingest.once(found.in_time, late=late).select("event_id"), "once").collect()}
    slots = ingest.drained(ingest.slot_counts(found.in_time, "1 second", ["event_id"], late=late), "slots")
    after, refused = ({r.event_id for r in x.collect()} for x in (found.late, found.refused))
    assert once | after | refused == whole and not once & after and not after & refused
    assert bool(after) == (late != "400 days")
    closed = {r.event_id for r in slots.collect()}
    assert closed <= once and (late == "400 days" or len(once - closed) <= len(once) // 10 + 5)


def test_queries_over_folders_of_parts(spark, tmp_path):
    table(spark, SF, "events").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_validated_ingest", "stream_dead_letter", "stream_hourly_counts", "stream_sessions"):
        one, many = (sorted(map(tuple, plans.queries()[name](spark, sf).collect())) for sf in (SF, str(tmp_path)))
        assert one == many, name


def test_repeats_equal_the_batch(spark):
    batch, stream = (sorted(map(tuple, plans.queries()[name](spark, SF).collect())) for name in ("repeat_suppression", "stream_repeats"))
    assert batch == stream and len(batch) < table(spark, SF, "events").count()


def test_repeats_across_batches(spark, tmp_path):
    rows = [(i, i * 10, 1, x) for i, x in enumerate("a b A c d e f g h i b a j a B".split())]
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4], "id long, ts_us long, device long, app string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
        time.sleep(0.05)
    kept, want = [], []
    for i, ts, _, x in rows:
        if not any(x.lower() == old and ts - at < 1000 for at, old in kept[-8:]):
            kept.append((ts, x.lower()))
            want.append(i)
    stream = ingest.files(spark, f"{tmp_path}/t", "*.parquet", spark.read.parquet(f"{tmp_path}/t").schema, per_batch=1)
    got = ingest.drained(stateful.without_repeats(stream, "device", "app", 1000), "repeats")
    assert sorted(r.id for r in got.collect()) == want


def test_intervals(spark, tmp_path):
    first = [(1, 1, 0, 10), (1, 2, 10, 20), (1, 3, 15, 25), (2, 4, 15, 25), (1, 5, 30, 30)]
    second = [(1, 1, 0, 10), (1, 6, 0, 10), (1, 7, 20, 30), (1, 8, 95, 120), (1, 9, 5, 6), (2, 4, 15, 25), (2, 10, 0, 15)]
    for own in (first, second):
        spark.createDataFrame(own, "device long, id long, start_us long, end_us long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
        time.sleep(0.05)
    stream = ingest.files(spark, f"{tmp_path}/t", "*.parquet", spark.read.parquet(f"{tmp_path}/t").schema, per_batch=1)
    got = defaultdict(list)
    for r in ingest.drained(stateful.appended(stream, "device", [(100, 110)]), "intervals").collect():
        got[r.id].append(r.outcome)
    want = {1: ["accepted", "replayed"], 2: ["accepted"], 3: ["overlapping"], 4: ["accepted", "replayed"], 5: ["invalid"], 6: ["overlapping"], 7: ["accepted"], 8: ["deleted"], 9: ["overlapping"], 10: ["accepted"]}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_intervals_of_the_events(spark):
    rows = plans.queries()["stream_intervals"](spark, SF).collect()
    assert len(rows) == table(spark, SF, "events").count()
    taken = defaultdict(list)
    for r in rows:
        if r.outcome == "accepted":
            taken[r.device].append((r.start_us, r.end_us))
    for own in taken.values():
        own.sort()
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
    assert {r.outcome for r in rows} == {"accepted", "overlapping", "deleted"}
