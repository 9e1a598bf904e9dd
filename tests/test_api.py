"""Questions asked over a small brain."""

from dataclasses import replace

from tidelog import api
from tidelog.operators.textindex import TextIndex, build
from tidelog.operators.timeline import DAY, MINUTE


def brain(spark):
    rows = [
        (1, 10 * DAY, "mail", 1, "Inbox", "https://www.google.com/search?q=red+fox", "the red fox report"),
        (2, 10 * DAY + MINUTE, "mail", 1, "Inbox", None, "lunch with the fox"),
        (3, 19 * DAY, "editor", 1, "code", "file:///x", "red fox code"),
    ]
    moments = spark.createDataFrame(rows, "id long, ts_us long, app string, device long, title string, url string, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.8, 0.6])], "id long, embedding array<double>")
    claims = spark.createDataFrame([(1, "a", "likes", "tea", "all", 0, None, 0, "active", 0.9), (2, "b", "is", "x", "all", 0, None, 0, "active", 0.9), (3, "b", "is", "y", "all", 0, None, 0, "active", 0.9)], "id long, subject string, predicate string, object string, scope string, valid_from long, valid_to long, asserted long, status string, confidence double")
    transitions = spark.createDataFrame([], "id long, claim long, effective long, asserted long, status string")
    return api.Brain(moments, vectors, claims=claims, transitions=transitions)


def test_recall(spark):
    b, now = brain(spark), 20 * DAY
    assert {r.outcome for r in api.recall(b, "red fox", now).collect()} == {"degraded: no embeddings"}
    assert [r.id for r in api.recall(b, "red fox", now, [1.0, 0.0], limit=2).collect()][0] in (1, 3)
    assert [r.id for r in api.recall(b, "red fox yesterday", now).collect()] == [3]
    assert {r.id for r in api.recall(b, "what was right after the red fox", now, [1.0, 0.0]).collect()} == {1, 2}
    assert [r.id for r in api.recall(b, "nothing zz fox lunch", now).collect()][0] == 2
    assert api.recall(b, "fox", now, start=5, end=1).count() == 0


def test_recall_by_index_names_and_answers(spark, tmp_path):
    now, b = 20 * DAY, brain(spark)
    texts = spark.createDataFrame([(1, "Mara approved the red fox report."), (2, "lunch with the foxes"), (3, "red fox code of m@x.org")], "id long, text string")
    moments = b.moments.drop("text").join(texts, "id")
    build(texts, f"{tmp_path}/i")
    mentions = spark.createDataFrame([(1, "Mara"), (3, "m@x.org"), (2, "Bo")], "id long, name string")
    identities = spark.createDataFrame([("p", "Mara"), ("p", "m@x.org"), ("q", "Bo")], "identity string, name string")
    b = replace(b, moments=moments, index=TextIndex(spark, f"{tmp_path}/i"), mentions=mentions, identities=identities)
    assert {r.name for r in api.names_in(b, "what of M@X.org or Zed?").collect()} == {"m@x.org", "Mara", "Zed", "M@X.org"}
    got = api.recall(b, "Who approved the red fox report?", now, [1.0, 0.0]).collect()
    assert got[0].id == 1 and {r.outcome for r in got} == {"degraded: not qualified"}
    assert {r.outcome for r in api.recall(b, "Who approved the red fox report?", now, [1.0, 0.0], verdict="supported").collect()} == {"matched"}
    assert api.recall(b, "How long was the red fox report?", now, [1.0, 0.0]).collect() == []
    by_name = {r.id: r.mentions for r in api.recall(b, "Mara fox", now, [1.0, 0.0]).collect()}
    assert by_name == {1: 1, 2: 0, 3: 1}


def test_other_questions(spark):
    b = brain(spark)
    assert [r.id for r in api.events_since(b, 10 * DAY).collect()] == [2, 3]
    assert [r.id for r in api.events_by_app(b, "mail").collect()] == [2, 1]
    assert api.stats(b).first().n == 3
    assert api.episodes(b).count() == 2 and api.sessions(b, 0, 20 * DAY).count() == 2
    assert [r["query"] for r in api.searches(b).collect()] == ["red fox"]
    assert [r.id for r in api.context(b, 20 * DAY).collect()] == [1]
    assert api.day(b, 10 * DAY).count() == 1
