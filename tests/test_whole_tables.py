"""Queries take every row of their tables, whatever its key or length: small tables, worked out by brute force."""

import itertools
import random
from datetime import datetime

from tidelog import plans


def run(spark, name, folder, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return plans.queries()[name](spark, str(folder)).collect()


def test_digest_scores_takes_every_document(spark, tmp_path):
    texts = {0: "the idiot web", 299: "a b", 300: "The stupid idiot", 5000: "x " * 30 + "web", 10**12: "the\nweb " * 10}
    got = run(spark, "digest_scores", tmp_path, documents=([(i, t, "web") for i, t in texts.items()], "doc_id long, text string, source string"))
    want = {i: (("stupid" in t.lower()) + ("idiot" in t), len(t.split()), 20 <= len(t.split()) <= 400, (("web" in t) + ("the" in t.lower())) / 2) for i, t in texts.items()}
    assert {r["id"]: (r["forbidden"], r["words"], r["fits"], r["coverage"]) for r in got} == want


def test_window_attribution_takes_every_frame(spark, tmp_path):
    keys = [1, 2, 1998, 1999, 2000, 2001, 7000, 10**10]
    orders = [(k, (k * 7) % 50) for k in keys]
    lineitem = [(k, n, (k * 31 + n * 17) % 100, (k * 13 + n * 29) % 100) for k in [*keys, 2002, 7002] for n in range(1, 5)]
    got = run(
        spark, "window_attribution", tmp_path,
        orders=(orders, "o_orderkey long, o_custkey long"),
        lineitem=(lineitem, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"),
    )
    want = {}
    for (frame, line, x, y), (k, c), d in itertools.product(lineitem, orders, range(3)):
        if k + d == frame and c % 40 <= x <= c % 40 + 60 and c % 30 <= y <= c % 30 + 60:
            want[frame, line] = min(want.get((frame, line), (99, 0)), (k % 5 + d, c))
    assert {(r["frame"], r["line"]): r["window"] for r in got} == {k: v[1] for k, v in want.items()}
    assert max(want)[0] > 2000


def sentences(n):
    """Texts of 1 to 60 words of which many restate another; some without a length."""
    rng = random.Random(3)
    words = [f"w{i}x" for i in range(70)] + ["the", "and"] * 4
    rows = []
    for i in range(n):
        picked = rng.choices(words, k=rng.randint(1, 60))
        if rows and i % 3:
            old = rng.choice(rows)[1].split()
            picked = rng.sample(old, -(-len(old) * 4 // 5)) + picked[: len(old) // 4]
        text = " ".join(picked) if i != 5 else None
        rows.append((i, text or "", "en" if i % 2 else "de", None if i % 7 == 0 else len(text or "")))
    return rows, "doc_id long, text string, lang string, n_chars long"


def restating(a, b):
    return len(a & b) >= 2 and len(a & b) * 5 >= min(len(a), len(b)) * 3


def test_restated_lines_takes_every_text(spark, tmp_path):
    rows, schema = sentences(90)
    got = run(spark, "restated_lines", tmp_path, documents=(rows, schema))
    sets = {i: set(t.split()) for i, t, *_ in rows}
    want = sorted((a, b) for a, b in itertools.combinations(sets, 2) if restating(sets[a], sets[b]))
    assert sorted((r["a"], r["b"]) for r in got) == want
    assert any(len(rows[a][1]) >= 250 for a, _ in want)


def test_proposition_integration_takes_every_text(spark, tmp_path):
    rows, schema = sentences(120)
    got = run(spark, "proposition_integration", tmp_path, documents=(rows, schema))
    sets, topic = {i: set(t.split()) for i, t, *_ in rows}, {i: lang for i, _, lang, _ in rows}
    alike = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    want = {}
    for i in sets:
        if i % 3 == 0:
            near = [j for j in sets if topic[j] == topic[i] and j != i]
            gone = any(alike(sets[i], sets[j]) >= 0.6 or restating(sets[i], sets[j]) for j in near if j % 3 == 2)
            best = max(((alike(sets[i], sets[j]), -j) for j in near if j % 3 == 1), default=(0, 0))
            want[i] = ("skip", None) if gone else ("merge", -best[1]) if best[0] >= 0.7 else ("insert", None)
    assert {r["id"]: (r["fate"], r["into"]) for r in got} == want


def test_sending_gate_takes_means_exactly(spark, tmp_path):
    """Means of just 0.05 aren't over it, though sums of doubles in any order are; what decimals don't hold goes by doubles."""
    discounts = {2: [0.05] * 3, 3: [0.0, 0.07, 0.08], 4: [0.01, 0.07, 0.07], 7919: [0.05, 0.05, 0.051], 8: [0.04, 0.05, 0.06 - 1e-16], 9: [1e300, None, 1.0], 12: [float("nan"), 0.0, 0.0], 14: [None] * 3}
    assert all(sum(p) / 3 > 0.05 for k in (2, 3, 4) for p in itertools.permutations(discounts[k]))
    rows = [(10 * k + i, k, d, datetime(2024, 1, 1 + i)) for k, ds in discounts.items() for i, d in enumerate(ds)]
    got = run(spark, "sending_gate", tmp_path, lineitem=(rows, "l_orderkey long, l_suppkey long, l_discount double, l_shipdate timestamp_ntz"))
    assert {r["id"]: r["held"] for r in got} == {2: "not sure", 3: "not sure", 4: "not sure", 7919: None, 8: "not sure", 9: None, 12: None, 14: "only names and labels"}
