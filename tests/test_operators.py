"""Boundary cases of the operators, worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import text, urls
from tidelog.functions.ids import CROCKFORD, stable_id
from tidelog.operators import claims, evaluate, extract, graph, retention, search, store, timeline, usermodel

S, M, D = timeline.SECOND, timeline.MINUTE, timeline.DAY


def moments(spark, *rows):
    return spark.createDataFrame([(i, ts, app, 1) for i, (ts, app) in enumerate(rows)], "id long, ts_us long, app string, device long")


def col(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("id",))).collect()]


def test_episode_gap_is_exclusive(spark):
    rows = moments(spark, (0, "a"), (10 * M, "a"), (20 * M + 1, "a"), (20 * M + 2, "b"))
    assert col(timeline.episodes(rows), "episode") == [1, 1, 2, 3]


def test_context_rows_join_and_do_not_move_the_clock(spark):
    rows = moments(spark, (0, "c"), (M, "a"), (9 * M, "c"), (12 * M, "a"))
    out = timeline.episodes(rows, is_focus=F.col("app") != "c")
    assert col(out, "episode") == [1, 2, 2, 3]


def test_session_gap_is_inclusive_and_sessions_are_cut_at_their_length(spark):
    rows = moments(spark, (0, "a"), (5 * M, "a"), (9 * M, "a"), (9 * M + 1, "a"))
    assert col(timeline.sessions(rows), "session") == [1, 2, 2, 2]
    rows = moments(spark, *[(i * 4 * M, "a") for i in range(20)])
    assert col(timeline.sessions(rows), "session") == [1] * 8 + [2] * 8 + [3] * 4


def test_empty_and_single(spark):
    none = moments(spark, (0, "a")).limit(0)
    assert timeline.episodes(none).count() == timeline.sessions(none).count() == timeline.spans(none, ["device"], ["app"]).count() == 0
    one = moments(spark, (7, "a"))
    assert col(timeline.sessions(one), "session") == [1]
    assert timeline.spans(one, ["device"], ["app"]).select("start_us", "end_us", "n").first() == (7, 7, 1)


def test_back_and_forth_counts_the_first_twice(spark):
    rows = moments(spark, *[(i, "ab"[i % 2]) for i in range(4)])
    assert timeline.back_and_forth(rows).select("left", "right", "times").collect() == [("a", "b", 3)]
    assert timeline.back_and_forth(rows.where("id < 3")).count() == 0


def test_repeats_compare_with_kept_rows_only(spark):
    rows = moments(spark, (0, "Q"), (50 * S, "q"), (100 * S, "q"), (130 * S, "x"))
    assert col(timeline.collapsed_repeats(rows, "device", "app"), "id") == [0, 2, 3]


def test_as_of_tolerance_and_ties(spark):
    left = moments(spark, (100, "a"), (200, "a"))
    right = spark.createDataFrame([(1, 100, "x"), (1, 90, "y")], "device long, ts_us long, v string")
    assert col(timeline.as_of(left, right, "device", "v", 50), "v") == ["x", None]
    assert col(timeline.as_of(left, right, "device", "v", 50, inclusive=False), "v") == ["y", None]


def test_empty_interval_lasts_a_microsecond(spark):
    points = spark.createDataFrame([(1, 5), (1, 6)], "device long, ts_us long")
    spans = spark.createDataFrame([(1, 5, 5)], "device long, start_us long, end_us long")
    assert [r.ts_us for r in timeline.points_in_intervals(points, spans, "device", 10).collect()] == [5]


def test_restart_counts_from_zero(spark):
    rows = moments(spark, (0, "a"), (1, "a"), (2, "a")).withColumn("n", F.when(F.col("id") == 0, 5).when(F.col("id") == 1, 9).otherwise(3))
    assert timeline.health(rows, "n").select("growth", "restarts").first() == (7, 1)


def test_ranges_that_touch_merge(spark):
    rows = spark.createDataFrame([("k", 0, 5), ("k", 5, 7), ("k", 8, 9)], "key string, start long, end long")
    assert sorted((r.start, r.end) for r in store.coalesced_ranges(rows, "key").collect()) == [(0, 7), (8, 9)]


def test_even_sample_keeps_first_and_last(spark):
    rows = moments(spark, *[(i, "a") for i in range(10)])
    assert col(store.even_sample(rows, 4), "id") == [0, 3, 6, 9]
    assert col(store.even_sample(rows, 1), "id") == [9]
    assert col(store.even_sample(rows, 20), "id") == list(range(10))


def test_inverted_ranges(spark):
    rows = moments(spark, (0, "a"))
    with pytest.raises(ValueError):
        store.in_range(rows, 2, 1)
    assert store.matching(rows, 2, 1).count() == 0


def test_url_prefix_needs_a_slash(spark):
    rows = spark.createDataFrame([("https://a/b",), ("https://a/bc",), ("https://a/b/c",)], "url string")
    assert sorted(r.url for r in store.under_url(rows, "https://a/b/").collect()) == ["https://a/b", "https://a/b/c"]


def test_capped_text_never_cuts_a_character(spark):
    rows = spark.createDataFrame([(1, "é" * 100_000)], "id long, text string")
    out = store.capped_text(rows, 1).first().text
    assert out == "é" * 65536


def test_tied_scores_share_a_rank(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 1.0)], "id long, score double")
    assert col(search.reciprocal(rows, "score", "rr"), "rr") == [1.0, 1.0, pytest.approx(1 / 3)]


def test_router():
    now = 100 * search.DAY
    assert search.route("what did I read right before lunch", now).shape == "anchor"
    assert search.route("notes from yesterday", now) == search.Route("range", now - 2 * search.DAY, now - search.DAY)
    assert search.route("last monday", now) == search.Route("range", now - 14 * search.DAY, now - 7 * search.DAY)
    assert search.route("monday plans", now) == search.Route("range", now - 7 * search.DAY, now)
    assert search.route("plans", now).shape == "plain"
    assert search.intersection((1, 5), (3, None)) == (3, 5)


def test_question_terms():
    assert search.phrases("what's next?  a@b.c") == [["what", "s"], ["next"], ["a", "b", "c"]]
    assert search.relaxed_terms("what is the Plan of the plan X9") == ["plan", "x9"]
    assert search.expanded("ask bob now", [["Bob", "Robert Ray"], ["Eve"]]) == [["bob"], ["robert", "ray"]]


def test_bm25_phrases_and_no_terms(spark):
    rows = spark.createDataFrame([(1, "red fox, red fox"), (2, "fox red"), (3, None)], "id long, text string")
    assert [r.id for r in search.bm25(rows, [["red", "fox"]]).collect()] == [1]
    assert search.bm25(rows, []).count() == 0


def test_diversity_prefers_what_is_new(spark):
    rows = spark.createDataFrame([(1, 1.0, ["a", "b"]), (2, 0.9, ["a", "b"]), (3, 0.5, ["c"])], "id long, score double, words array<string>").withColumn("q", F.lit(1))
    out = search.diverse(rows, ["q"], 2)
    assert {r.id: r.place for r in out.collect()} == {1: 1, 3: 2}


def test_validity_is_inclusive_and_late_transitions_do_not_count(spark):
    c = spark.createDataFrame([(1, 10, 20, 5, "active")], "id long, valid_from long, valid_to long, asserted long, status string")
    t = spark.createDataFrame([(1, 1, 12, 30, "retracted")], "id long, claim long, effective long, asserted long, status string")
    assert claims.active_as_of(c, t, 20, 29).count() == claims.active_as_of(c, t, 10, 29).count() == 1
    assert claims.active_as_of(c, t, 21, 29).count() == claims.active_as_of(c, t, 20, 30).count() == 0
    assert claims.active_as_of(c, t, 10, 4).count() == 0


def test_identity_rules(spark):
    people = spark.createDataFrame([(1, "Dr. Ann Lee"), (2, "Bo Kim"), (3, "Ann")], "id long, name string")
    mail = spark.createDataFrame([(10, "ann.lee7@x.org"), (11, "bkim@x.org"), (12, "zzz@x.org")], "id long, email string")
    got = {r.email_id: (r.person_id, r.rule) for r in graph.email_matches(people.where("id < 3"), mail).collect()}
    assert got == {10: (1, "email_exact"), 11: (2, "email_initial")}
    assert graph.single_tokens(people).collect() == [(3, 1)]


def test_retention_is_strict_and_spares_the_last_hour():
    assert retention.cutoff(100 * D, 7) == 93 * D
    assert retention.cutoff(100 * D, 0) == 100 * D - timeline.HOUR


def test_staleness(spark):
    rows = spark.createDataFrame([(0.9, 0), (0.7, 0), (0.4, 0), (0.1, 0)], "decay double, updated long")
    at = lambda days: [r[0] for r in rows.select(usermodel.stale(F.col("decay"), F.col("updated"), F.lit(days * D))).collect()]
    assert at(1) == [True, False, False, False] and at(45) == [True, True, True, False]


def test_scores_without_hits(spark):
    hits = spark.createDataFrame([], "query long, rank int, id long")
    out = evaluate.ranked_scores(hits, spark.createDataFrame([(1, 5)], "query long, id long"), 5).first()
    assert (out.precision, out.recall, out.hit, out.rr) == (0, 0, 0, 0)


def test_secrets_are_masked_before_entities(spark):
    key = "AKIA" + "A" * 16
    rows = spark.createDataFrame([(1, f"see https://a.b/{key} or me@x.org, ME@X.ORG.")], "id long, text string")
    got = {(r.kind, r.name, r.n) for r in extract.mentions(rows).collect()}
    assert ("email", "me@x.org", 2) in got and not any(key in name for _, name, _ in got)
    assert rows.select(extract.secret_kinds(F.col("text"))).first()[0] == ["aws_access_key"]


def test_entity_kinds(spark):
    uuid, ulid, eth = "123E4567-e89b-12d3-a456-426614174000", "01ARZ3NDEKTSV4RRFFQ69G5FAV", "0x" + "aB" * 20
    sol, wif = "So" + "1" * 41, "5" + "K" * 50
    cases = [
        ("https://Example.COM/Path?Q=1#Frag).", "url", "https://example.com/Path?Q=1#Frag"),
        ("Me@X.org", "email", "me@x.org"),
        ("+1 415 555 1234", "phone", "14155551234"),
        ("192.168.0.255", "ip_address", "192.168.0.255"),
        ("2001:DB8:0:0:0:0:0:1", "ip_address", "2001:db8:0:0:0:0:0:1"),
        ("bc1q" + "w" * 30, "crypto_address", "bc1q" + "w" * 30),
        ("1" + "A" * 30, "crypto_address", "1" + "A" * 30),
        (eth, "crypto_address", eth),
        (sol, "crypto_address", sol),
        ("(#42)", "github_ref", "42"),
        (ulid.lower(), "ulid", ulid),
        ("see [/usr/local/bin]", "file_path", "/usr/local/bin"),
        ("[REDACTED:SMS_OTP]", "redacted_token", "cascade_redacted"),
        (wif, "redacted_token", "bitcoin_wif"),
        ("sk_live_" + "a" * 24, "redacted_token", "stripe_api_key"),
        ("ghp_" + "a" * 36, "redacted_token", "github_pat"),
        ("eyJ" + "a" * 8 + "." + "b" * 8 + "." + "c" * 4, "redacted_token", "jwt"),
    ]
    rows = spark.createDataFrame([(i, f"é \x01{t} end") for i, (t, _, _) in enumerate(cases)], "id long, text string")
    got = {(r.id, r.kind, r.name, r.n) for r in extract.mentions(rows).collect()}
    assert got == {(i, kind, name, 1) for i, (_, kind, name) in enumerate(cases)}
    none = ["256.1.1.1", "12345", "x#42", "a/b", "AKIA" + "A" * 17, "", None]
    assert extract.mentions(spark.createDataFrame([(i, t) for i, t in enumerate(none)], "id long, text string")).where("kind <> 'ip_address'").isEmpty()
    # hexadecimal runs of a uuid can begin like a phone number: the span that begins first stays
    first = extract.spans(F.lit(f"{uuid} é a@b.org, a@b.org/x/y"))
    assert [(m["begin"], m["end"], m["kind"]) for m in spark.range(1).select(first).first()[0]] == [(0, 36, "uuid"), (39, 46, "email"), (48, 55, "email")]


def test_spans_agree_with_a_plain_scan(spark):
    import random
    import re

    rng = random.Random(5)
    bits = ["https://a.b/c.", "me@x.org", "1.2.3.4", " ", " (", ")", "#12", "/a/b/c", "+44 207 946 0123", "AKIA" + "B" * 16, "x", "é", ",", "[REDACTED:A]", "01ARZ3NDEKTSV4RRFFQ69G5FAV"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(300)]

    def plain(t):
        found, blank = [], re.sub(extract.SECRET, lambda m: " " * len(m[0]), t)
        for order, (kind, form, before, pattern) in enumerate(extract.ENTITIES):
            for m in re.finditer(f"({before})({pattern})".replace(r"\x{85}\p{Z}", "\x85\xa0").replace(r"\z", r"\Z"), t if form in dict(extract.SECRETS) else blank):
                v = re.sub(r"[.,;:!?)\]}]+\Z", "", m[2]) if form == "url" else m[2]
                if form != "phone" or sum(c.isdigit() for c in v) >= 10:
                    found.append((m.start(2), m.start(2) + len(v), order, kind))
        kept, reach = [], 0
        for b, e, _, kind in sorted(found):
            if b >= reach:
                reach = e
                kept.append((b, e, kind))
        return kept

    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: [(m["begin"], m["end"], m["kind"]) for m in r.m] for r in rows.select("id", extract.spans(F.col("text")).alias("m")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 1000


def test_every_rule_fires_and_plain_texts_stay(spark):
    from tidelog.plans.extract import _NOTICES

    rows = spark.createDataFrame(list(enumerate(_NOTICES)), "id long, text string")
    got = {r.id: r for r in extract.redacted(rows).collect()}
    assert [name for i, (name, _) in enumerate(extract.RULES) if name in got[i].rules] == [name for name, _ in extract.RULES]
    assert got[0].text == "[REDACTED:BANK_NOTIFICATION]" and got[2].text == "[REDACTED:SMS_OTP]" and "482" not in got[1].text
    plain = ["Door code is the building, not a secret.", "Call 555-018-2734", "4821 Elm Street", "", None]
    kept = extract.redacted(spark.createDataFrame(list(enumerate(plain)), "id long, text string")).orderBy("id").collect()
    assert [(r.text, r.rules) for r in kept] == [(t or "", []) for t in plain]


def test_chunks_pack_greedily(spark):
    texts = [None, " \n ", "short  text.\n\nkept ", "A b. C d e! F\n\n\n g? h i", "a b c d e f. x", "one. two.\n\nthree four. five", "e.g.x a b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in extract.chunks(rows, 4).orderBy("id", "n").collect():
        got.setdefault(r.id, []).append(r.chunk)
    assert got == {
        2: ["short  text.\n\nkept "], 3: ["A b.", "C d e! F", "g? h i"], 4: ["a b c d e f.", "x"],
        5: ["one. two.\n\nthree four.", "five"], 6: ["e.g.x a b c"],
    }
    tiny = extract.chunks(rows.where("id = 3"), 0).orderBy("n").collect()
    assert [r.chunk for r in tiny] == ["A b.", "C d e!", "F", "g?", "h i"]


def test_unknown_conditions_suppress(spark):
    rows = spark.createDataFrame([(None,), (True,), (False,)], "x boolean")
    assert [r[0] for r in rows.select(extract.cascade((F.col("x"), "deny"))).collect()] == ["suppress: unknown", "deny", "allow"]


def test_search_addresses(spark):
    rows = spark.createDataFrame([("https://www.google.co.uk/search?q=a+b%21",), ("https://en.wikipedia.org/w/index.php?search=x",), ("https://notgoogle.com/search?q=a",), ("junk",)], "url string")
    got = [tuple(r[0]) if r[0] else None for r in rows.select(urls.search_query(F.col("url"))).collect()]
    assert got == [("google", "a b!"), ("wikipedia", "x"), None, None]


def test_ids_are_stable(spark):
    import hashlib

    got = spark.range(1).select(stable_id(F.lit("entity"), F.lit("x"))).first()[0]
    n = int(hashlib.sha256(b"entity\0x").hexdigest()[:32], 16)
    assert got == "".join(CROCKFORD[n >> (5 * i) & 31] for i in range(25, -1, -1))


def test_word_functions(spark):
    row = spark.createDataFrame([("  a  b ", None, "x" * 5)], "a string, b string, c string")
    out = row.select(text.word_count(F.col("a")), text.word_count(F.col("b")), text.cut(F.col("c"), 4), text.coverage(F.lit("red fox"), F.lit("the red"))).first()
    assert tuple(out) == (2, 0, "xxx…", 0.5)


def test_packets_pass_over_what_does_not_fit(spark):
    rows = [(1, 0.9, 5), (2, 0.9, 9), (3, 0.8, 4), (4, 0.7, 2), (5, 0.5, 1), (6, 0.66, 1)]
    frame = spark.createDataFrame([(*r, "a") for r in rows] + [(7, 0.9, 20, "b"), (8, 0.7, 10, "b")], "id long, confidence double, n_tokens int, part string")
    assert [(r.id, r.used) for r in claims.packet(frame.where("part = 'a'"), 10, 10).orderBy("used").collect()] == [(1, 5), (3, 9), (6, 10)]
    assert {(r.id, r.used) for r in claims.packet(frame.where("part = 'a'"), 2, 10).collect()} == {(1, 5)}
    assert {(r.part, r.id) for r in claims.packet(frame, 10, 10, keys=("part",)).collect()} == {("a", 1), ("a", 3), ("a", 6), ("b", 8)}
    assert claims.packet(frame.limit(0), 10, 10).collect() == []


def plain_expansion(claims_of, proofs, events, graph, b):
    """One request, step by step."""
    fits = {c: min(b.nodes, b.edges, b.evidence, b.tokens) > 0 and any(len((events[e][0] or "").split()) <= b.tokens for _, e in proofs.get(c, []) if e in events) for c in claims_of}
    out, seen, nodes, edges, tokens, n, cut = [], set(), 0, 0, 0, 0, False
    for c in sorted(claims_of, key=lambda c: (not fits[c], c)):
        if nodes == b.nodes:
            cut = True
            continue
        nodes += 1
        out.append(("claim", str(c), None))
        for p, e in sorted(proofs.get(c, [])):
            if e not in events:
                continue
            text, episode = events[e]
            w = len((text or "").split())
            if n == b.evidence or edges == b.edges or w > b.tokens - tokens:
                cut = True
                continue
            tokens, edges, n = tokens + w, edges + 1, n + 1
            out.append(("evidence", str(p), w))
            links = [("episode", episode)] + [x for entity, identity in sorted(graph.get(e, []), key=str) for x in (("entity", entity), ("identity", identity))]
            for kind, node in links:
                if node is None or (kind, node) in seen:
                    continue
                if nodes == b.nodes or edges == b.edges:
                    cut = True
                    continue
                seen.add((kind, node))
                nodes, edges = nodes + 1, edges + 1
                out.append((kind, str(node), None))
    return [*out, ("end", "", tokens)], cut


@pytest.mark.parametrize("budget", [(12, 14, 5, 60), (3, 100, 100, 1000), (100, 3, 100, 1000), (100, 100, 2, 1000), (100, 100, 100, 9), (0, 0, 0, 0), (5, 0, 5, 5)])
def test_expansion_within_budgets(spark, budget):
    rng, b = random.Random(sum(budget)), claims.Budget(*budget)
    events = {e: (rng.choice([None, "", "w " * rng.randint(1, 12)]), rng.choice([None, e % 3])) for e in range(25)}
    graph = {e: [(f"e{e % 6}", f"i{e % 2}"), (f"e{e % 4 + 6}", None)][: rng.randint(0, 2)] for e in range(25)}
    proofs = {c: [(c * 10 + k, rng.randint(0, 28)) for k in range(rng.randint(0, 4))] for c in range(12)}
    wanted = {r: [rng.randint(0, 14) for _ in range(rng.randint(1, 6))] for r in range(8)}
    frame = spark.createDataFrame
    got = {}
    out = claims.expansion(
        frame([(r, c) for r, cs in wanted.items() for c in cs], "request long, claim long"), frame([(c, p, e) for c, ps in proofs.items() for p, e in ps], "claim long, id long, event long"),
        frame([(e, t, x) for e, (t, x) in events.items()], "event long, text string, episode long"), frame([(e, n) for e, ns in graph.items() for n, _ in ns], "event long, entity string"),
        frame([(f"e{k}", f"i{i}") for k in range(6) for i in {e % 2 for e in range(25) if e % 6 == k}], "entity string, identity string"), b,
    )
    for r in sorted(out.collect(), key=lambda r: (r.request, r.place)):
        got.setdefault(r.request, []).append(((r.kind, r.node, r.n_tokens), r.truncated))
    for r, cs in wanted.items():
        want, cut = plain_expansion(set(cs), proofs, events, graph, b)
        assert [x for x, _ in got[r]] == want and got[r][-1][1] == cut
