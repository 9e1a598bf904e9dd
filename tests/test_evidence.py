"""The veto on missing answers, the score and the outcomes, by hand-worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from tidelog.operators import evidence as e

CASES = [
    ("How many cases are in the release corpus?", "The release corpus contains 24 cases.", "supported"),
    ("How many cases are in the release corpus?", "The release corpus is documented in the README.", "unsupported"),
    ("How many cases passed?", "Cases of version 3 passed.", "unsupported"),
    ("How many cases passed?", "3 cases", "supported"),
    ("How many cases passed?", "Forty cases; they passed", "supported"),
    ("How many of the 24 cases passed?", "24 cases", "unsupported"),
    ("How long did the focused test run take?", "The focused test run completed in 42 seconds.", "supported"),
    ("How long did the focused test run take?", "The focused test run completed successfully.", "unsupported"),
    ("What was the duration of the run?", "The run took 42s? No, the run took 42min.", "supported"),
    ("How long was the run?", "An overnight run", "supported"),
    ("What due date was set for the migration?", "The migration is due on September 18.", "supported"),
    ("What due date was set for the migration?", "The migration has an assigned owner.", "unsupported"),
    ("What date is the opening?", "The opening is on 2024-05-01", "supported"),
    ("What date is the opening?", "The opening is on 2024-05/01", "unsupported"),
    ("What date is the opening?", "The opening is on May day", "unsupported"),
    ("What due date did Priya set for HIPP 201?", "[app=linear | ts=2026-09-02]\nUpdated note says Priya owns HIPP 201.", "unsupported"),
    ("Who approved the balcony inspection?", "Mara approved the balcony inspection.", "supported"),
    ("Who approved the balcony inspection?", "Mara approved the patio permit. The balcony inspection was filed.", "unsupported"),
    ("Who approved the balcony inspection?", "Someone approved the balcony inspection on Monday.", "unsupported"),
    ("Who approved the balcony inspection?", "The balcony inspection was done by Mara", "supported"),
    ("Whom did they name?", "", "unsupported"),
    ("What due date was set for the furnace repair?", "The boiler inspection is due on October 1. The furnace repair was discussed.", "unsupported"),
    ("Why did partial benchmark runs change?", "The rollback changed partial benchmark runs to fail closed.", "not_applicable"),
    (None, "text", "not_applicable"),
    ("Who?", None, "unsupported"),
]


def test_signals(spark):
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(CASES)], "i int, question string, text string").repartition(4)
    got = {r.i: r.signal for r in e.explicit_relations(rows, "i").collect()}
    assert [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[2]] == []
    assert e.explicit_relations(rows.limit(0), "i").collect() == []


def test_one_of_many_texts_is_enough(spark):
    q = "What is the current deadline of the audit?"
    rows = spark.createDataFrame([(1, q, "no"), (1, q, "The audit is due by Friday"), (2, q, "[app=x | y]\nIt SUPERSEDES the previous note"), (2, q, None)], "i int, question string, text string")
    assert {r.i: (r.signal, r.superseding) for r in e.explicit_relations(rows, "i").collect()} == {1: ("supported", False), 2: ("unsupported", True)}


def test_features(spark):
    rows = [(1, 0.5, "The north entrance leads directly to the sculpture garden."), (2, 0.7, "unrelated"), (3, 0.7, None)]
    frame = spark.createDataFrame([(*r, "Which entrance leads directly to the sculpture garden?") for r in rows], "id long, cosine double, text string, question string")
    f = e.features(frame).first()
    assert (f.cosine, f.margin, f.agreement, f.query_coverage) == (0.7, 0.0, 0.0, 1.0)
    assert f.document_coverage == pytest.approx(5 / 6) and f.novelty == pytest.approx(5 / 9)
    one = e.features(frame.where("id = 1")).first()
    assert (one.margin, one.agreement) == (0.0, 1.0)


def test_scores(spark):
    good = dict(zip(e.FEATURES, (0.8, 0.2, 0.5, 0.5, 1.0, 0.5)))
    bad = [{**good, k: v} for k, v in (("cosine", float("nan")), ("margin", -0.1), ("query_coverage", 1.1), ("agreement", 0.5), ("novelty", None), ("cosine", float("inf")))]
    frame = spark.createDataFrame([tuple(x[c] for c in e.FEATURES) for x in (good, *bad)], ", ".join(f"{c} double" for c in e.FEATURES))
    got = [r.s for r in frame.select(e.sufficiency({c: F.col(c) for c in e.FEATURES}).alias("s")).collect()]
    logit = e.INTERCEPT + sum(w * (good[c] - m) / s for c, m, s, w in zip(e.FEATURES, e.MEANS, e.SCALES, e.WEIGHTS))
    assert got[0] == pytest.approx(1 / (1 + math.exp(-logit))) and got[1:] == [None] * len(bad)


@pytest.mark.parametrize("qualified", [False, True])
def test_outcomes(spark, qualified):
    cases = [
        (3, True, "supported", False, "supported", None, "matched"), (3, True, "not_applicable", False, "contradicted", None, "contradicted"),
        (3, True, "supported", False, "insufficient", 0.9, "nothing_matched"), (3, True, "unsupported", False, "supported", 0.9, "nothing_matched"),
        (3, True, "unsupported", True, "supported", 0.9, "matched"), (0, True, "not_applicable", False, None, None, "nothing_matched"),
        (3, False, "supported", False, "supported", 0.9, "degraded: no embeddings"),
        (3, True, "supported", False, None, 0.9, "matched" if qualified else "degraded: not qualified"),
        (3, True, "supported", False, None, 0.1, "nothing_matched" if qualified else "degraded: not qualified"),
    ]
    frame = spark.createDataFrame(cases, "n int, embedded boolean, signal string, superseding boolean, verdict string, score double, want string")
    got = frame.withColumn("got", e.outcome(*[F.col(c) for c in frame.columns[:-1]], qualified=qualified)).where("got <> want").collect()
    assert got == []
