"""Stems, scores and phrases held against SQLite's full-text search, which has the same rules."""

import random
import sqlite3

import duckdb
import pytest

from tidelog.functions import stems
from tidelog.operators import search
from tidelog.operators.textindex import TextIndex, build, stored

TOKENIZER = "tokenize='porter unicode61 remove_diacritics 2'"
SF = "/root/testdata/sf0.01"


def texts_of(sf):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by 1").fetchall()


def test_stems_of_all_words():
    rng, con = random.Random(3), sqlite3.connect(":memory:")
    endings = [e for e, _ in stems.STEP2 + stems.STEP3] + [*stems.STEP4, "s", "es", "ed", "ing", "y", "e", "ion", "sses", "ies", "eed", "ll"]
    made = ["".join(rng.choice(["b", "t", "a", "e", "i", "o", "y", "s", "l", "st", "w", "x", "z", "é"]) for _ in range(rng.randint(0, 6))) + rng.choice(endings) + rng.choice(["", *endings]) for _ in range(20_000)]
    texts = [t for _, t in texts_of(SF) if t] + [" ".join(made), "straße İx Ünïcödé naïve Ἀθῆναι русский йод 日本語 が 한국어 x² ½ a_b été", "w" * 70 + "ing"]
    con.execute(f"create virtual table plain using fts5(x, {TOKENIZER.replace('porter ', '')})")
    con.execute("create virtual table words using fts5vocab('plain', 'row')")
    con.executemany("insert into plain values (?)", [(t,) for t in texts])
    ours = sorted({w for t in texts for w in stems.words(t)})
    assert set(ours) == {r[0] for r in con.execute("select term from words")}
    con.execute(f"create virtual table stemmed using fts5(x, {TOKENIZER})")
    con.execute("create virtual table terms using fts5vocab('stemmed', 'instance')")
    con.executemany("insert into stemmed(rowid, x) values (?, ?)", list(enumerate(ours, 1)))
    assert [(ours[d - 1], stems.stem(ours[d - 1]), t) for t, d in con.execute("select term, doc from terms") if stems.stem(ours[d - 1]) != t] == []


WORDS = ["run", "Running", "runs", "café", "cafe", "meeting", "meetings", "red", "fox", "Foxes", "the", "under"]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30)))) for i in range(120)] + [(200, ""), (201, "Running café meetings"), (202, None), (203, "fox " * 500), (204, "...")]
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5(x, {TOKENIZER})")
    con.executemany("insert into t(rowid, x) values (?, ?)", rows)
    frame = spark.createDataFrame(rows, "id long, text string").repartition(3)
    folder = f"{tmp_path_factory.mktemp('index')}/i"
    build(frame, folder)
    return con, frame, TextIndex(spark, folder)


QUESTIONS = [
    (["run", "cafe", "meeting"], True), (["fox"], True), (["fox", "red"], False), (["red fox"], True), (["red fox", "the"], True), (["the the"], True),
    (["fox fox"], True), (["fox", "fox"], True), (["run", "runs"], False), (["café meeting", "under the fox", "zzz"], False), (["zzz"], True), (["zzz", "fox"], True),
]


@pytest.mark.parametrize("phrases, every", QUESTIONS)
def test_scores(world, phrases, every):
    con, frame, index = world
    asked = (" AND " if every else " OR ").join(f'"{p}"' for p in phrases)
    want = {i: -b for i, b in con.execute("select rowid, bm25(t) from t where t match ?", (asked,))}
    split = [p.split() for p in phrases]
    for found in (index.hits(split, every), search.bm25(frame, split, every=every).select("id", "score")):
        got = {r.id: r.score for r in found.collect()}
        assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_relaxed(world):
    _, frame, index = world
    for text, relaxed in (("red fox", False), ("what zzz foxes", True), ("zzz", None)):
        for found in (search.relaxed_hits(index, text), search.relaxed(frame, text).select("id", "score", "relaxed")):
            assert {r.relaxed for r in found.collect()} == (set() if relaxed is None else {relaxed})


def test_names_and_empty_questions(spark, world, tmp_path):
    _, _, index = world
    assert index.hits([]).collect() == [] and index.hits([["..."]], every=False).collect() == []
    build(spark.createDataFrame([(1, "Ann Lee met Ann Lee and Bo"), (2, "ann lee"), (3, "Ann Lee Ray Jo")], "id long, text string"), f"{tmp_path}/n")
    names = TextIndex(spark, f"{tmp_path}/n").named(search.capitalised("Did Ann Lee (Bo!) see Ann Lee Ray?"))
    assert {(r.id, r.mentions) for r in names.collect()} == {(1, 2), (3, 0)} - {(3, 0)}
    build(spark.createDataFrame([], "id long, text string"), f"{tmp_path}/e")
    assert TextIndex(spark, f"{tmp_path}/e").hits([["fox"]]).collect() == []


def test_capitalised():
    assert search.capitalised("Did Ann Lee (Bo!) see ann Lee?") == ["Did", "Did Ann", "Ann", "Ann Lee", "Lee", "Lee Bo", "Bo"]
    assert len(search.capitalised(" ".join(f"A{i}" for i in range(99)))) == 24


def test_stored_once_for_a_table_as_it_is(spark, tmp_path):
    path, root = f"{tmp_path}/t", f"{tmp_path}/root"
    spark.createDataFrame([(1, "red fox")], "id long, text string").write.parquet(path)
    first = stored(spark.read.parquet(path), root)
    assert stored(spark.read.parquet(path), root).folder == first.folder
    spark.createDataFrame([(2, "red foxes")], "id long, text string").write.mode("append").parquet(path)
    second = stored(spark.read.parquet(path), root)
    assert second.folder != first.folder and {r.id for r in second.hits([["fox"]]).collect()} == {1, 2}


def test_spellings_in_questions(spark):
    groups = [(1, "New York"), (1, "NYC"), (2, "u"), (2, "you"), (3, "YORK"), (4, ""), (5, "zebra crossing"), (5, "zebra"), (6, "中文")]
    asked = [(1, "the new york times"), (2, "nyc"), (3, "NEW Yor"), (4, "a zebra cros"), (5, ""), (6, None), (7, "說中文嗎")]
    got = search.expanded_rows(spark.createDataFrame(asked, "id long, text string"), spark.createDataFrame(groups, "group long, spelling string"))
    want = set()
    for i, q in asked:
        fired = {g for g, s in groups if s and q and s.lower() in q.lower()}
        want |= {(i, s) for g, s in groups if g in fired and s}
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
