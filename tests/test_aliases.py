"""Alias resolution: hand-worked cases, and a version that takes entities one by one."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidelog.operators import aliases
from tidelog.operators.graph import HONORIFICS
from tidelog.plans.aliases import named_entities
from tidelog.sources.tables import checkpointed

SF = "/root/testdata/sf0.001"


def words_of(name):
    w = re.findall(r"[^\W_]+", "".join(c.lower() if c.isascii() else c for c in name))
    while len(w) > 1 and w[0] in HONORIFICS:
        w = w[1:]
    return w


def label_of(url):
    host = re.split(r"[/?#]", url.strip().lower().split("://")[-1])[0].rsplit("@")[-1].split(":")[0].removeprefix("www.")
    labels = [x for x in host.split(".") if x]
    if len(labels) < 2 or all(x.isdigit() for x in labels):
        return None
    return labels[-3] if len(labels) > 2 and ".".join(labels[-2:]) in aliases.SUFFIXES else labels[-2]


def one_by_one(entities, mentions):
    """(core, id, rule), in the order of ids, leaf after leaf."""
    entities, events, beside = sorted(set(entities)), defaultdict(set), defaultdict(set)
    for i, e in mentions:
        events[i].add(e)
        beside[e].add(i)
    core, rule, cores, single = {}, {}, {}, []
    for i, kind, name in entities:
        if kind in aliases.NAMED:
            w, t = words_of(name), aliases.NAMED[kind]
            if t == "person" and len(w) == 1:
                single.append((i, w[0]))
            elif w:
                key = f"{t}:{' '.join(w)}"
                rule[i] = "exact_name" if key in cores else "anchor"
                core[i], cores[key] = key, w
    persons = {k: w for k, w in cores.items() if k.startswith("person:")}
    near = lambda i: {core[j] for e in events[i] for j in beside[e] if j != i and j in core}

    def put(i, k, r):
        core[i], rule[i] = k, r

    for i, w in single:
        fit = [k for k, v in persons.items() if w in v]
        if len(fit) == 1:
            put(i, fit[0], "name_variant")
    targets, weak = [], []
    for i, kind, name in entities:
        parts = name.strip().lower().split("@")
        if kind != "email" or len(parts) != 2 or not all(parts):
            continue
        w = [p for p in (re.sub(r"[0-9]+$", "", p) for p in re.split(r"[._+-]", parts[0])) if p]
        fit = [k for k, v in persons.items() if set(v) == set(w) or "".join(v) == "".join(w)] if w else []
        if len(fit) == 1:
            targets.append((i, fit[0], parts[1]))
        elif fit:
            kept = [k for k in fit if k in near(i)]
            if len(kept) == 1:
                put(i, kept[0], "email_name")
        elif len(w) == 1:
            weak.append((i, [k for k, v in persons.items() if w[0] == v[0][0] + v[-1]]))
    for i, k, _ in targets:
        if len({d for _, c, d in targets if c == k}) < 2 or k in near(i):
            put(i, k, "email_name")
    for i, fit in weak:
        kept = [k for k in fit if k in near(i)]
        if len(kept) == 1:
            put(i, kept[0], "email_name")
    for i, kind, _ in entities:
        if kind == "phone":
            fit = [k for k in near(i) if k.startswith("person:")]
            if len(fit) == 1:
                put(i, fit[0], "phone_cooccur")
    for i, kind, name in entities:
        if kind == "url":
            fit = [k for k, w in cores.items() if k.startswith("org:") and "".join(w) == label_of(name)]
            fit = fit if len(fit) < 2 else [k for k in fit if k in near(i)]
            if len(fit) == 1:
                put(i, fit[0], "domain_org")
    out = [(core[i], i, rule[i]) for i in core if list(core.values()).count(core[i]) >= 2]
    return sorted(out + [(f"person:{kind}:{name}", i, "handle_anchor") for i, kind, name in entities if kind in ("email", "phone") and i not in core and len(events[i]) >= 2])


def run(spark, entities, mentions, **options):
    frame = spark.createDataFrame(entities, "id string, kind string, name string")
    return aliases.resolved(frame, spark.createDataFrame(mentions, "id string, event long"), checkpointed(spark), **options).collect()


def partition(rows):
    """Members with their rules, whatever the identities are called."""
    out = defaultdict(set)
    for core, i, rule in rows:
        out[core].add((i, rule))
    return sorted(map(sorted, out.values()))


E = {"person": "person_name", "org": "organization", "place": "location"}


def ents(*rows):
    return [(f"{kind}:{name}", E.get(kind, kind), name) for kind, name in rows]


CASES = [
    # One person by name, address and a number beside the name.
    ([("person", "Alice Smith"), ("email", "alice.smith@corp.com"), ("phone", "15551234567")], [[0, 2]], [{0, 1, 2}]),
    ([("person", "Alice Smith"), ("person", "alice  smith")], [], [{0, 1}]),
    ([("org", "Stripe"), ("url", "https://www.stripe.com/pricing")], [], [{0, 1}]),
    # The same first name never merges, and alone it never bridges two people.
    ([("person", "Alice Smith"), ("person", "Alice Chen")], [], []),
    ([("person", "Alice Smith"), ("person", "Alice Chen"), ("person", "Alice")], [], []),
    ([("person", "Alice Smith"), ("person", "Alice")], [], [{0, 1}]),
    ([("person", "Alice Chen"), ("email", "alice.smith@corp.com")], [], []),
    # Two names with the same words: only one beside the address is taken.
    ([("person", "Sam Carter"), ("person", "Carter Sam"), ("email", "sam.carter@x.com")], [], []),
    ([("person", "Sam Carter"), ("person", "Carter Sam"), ("email", "sam.carter@x.com")], [[0, 2]], [{0, 2}]),
    ([("person", "Alice Smith"), ("person", "Bob Jones"), ("phone", "15550001111")], [[0, 1, 2]], []),
    ([("org", "Stripe"), ("url", "https://stripe-login.com/x")], [], []),
    ([("org", "Barclays"), ("org", "Co"), ("url", "https://www.barclays.co.uk/a")], [], [{0, 2}]),
    ([("place", "Paris"), ("place", "paris"), ("place", "Rome")], [], [{0, 1}]),
    ([("redacted_token", "otp"), ("redacted_token", "OTP")], [], []),
    ([("person", "Dr. Alice Smith"), ("person", "Alice Smith"), ("person", "Alice Smith Jr")], [], [{0, 1}]),
    # An initial and a last name always need company.
    ([("person", "Alice Smith"), ("email", "asmith@x.com")], [], []),
    ([("person", "Alice Smith"), ("email", "asmith@x.com")], [[0, 1]], [{0, 1}]),
    # Two domains for one name: each needs company.
    ([("person", "John Smith"), ("email", "john.smith@acme.com"), ("email", "john.smith@globex.com")], [], []),
    ([("person", "John Smith"), ("email", "john.smith@acme.com"), ("email", "john.smith@globex.com")], [[0, 1]], [{0, 1}]),
    ([("person", "John Smith"), ("email", "john.smith@acme.com"), ("email", "johnsmith2@acme.com")], [], [{0, 1, 2}]),
    # A number seen twice is someone; seen once it isn't.
    ([("phone", "15550001111"), ("email", "a@b.c")], [[0], [0], [1]], [{0}]),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_cases_one_by_one(n):
    """The plain version has the cases right; the operator is held against it below."""
    named, beside, want = CASES[n]
    rows = ents(*named)
    got = one_by_one(rows, [(rows[i][0], e) for e, own in enumerate(beside) for i in own])
    assert partition(got) == sorted(sorted((rows[i][0], r) for i, r in zip(sorted(w), [dict((m, r) for _, m, r in got)[rows[i][0]] for i in sorted(w)])) for w in want)


def test_resolution(spark):
    """All cases at once, each in a world of its own (its words carry its number), and worlds full of collisions."""
    rng, entities, mentions = random.Random(11), [], []
    for n, (named, beside, _) in enumerate(CASES):
        own = [(kind, re.sub(r"[A-Za-z]{2,}", lambda m: m[0] + "abcdefghijklmnopqrstuvwxyz"[n] * 3, name) if kind in ("person", "org", "place", "email") else name + str(n) * (kind == "phone")) for kind, name in named]  # noqa: B023
        rows = ents(*own)
        entities += rows
        mentions += [(rows[i][0], 1000 * n + e) for e, m in enumerate(beside) for i in m]
    first, last = ["ann", "bo", "cy", "Dé"], ["fox", "gray", "foxbo"]
    made = [("person", f"{rng.choice(['', 'Dr. ', 'Mr '])}{f} {x}") for f in first for x in last] + [("person", f) for f in (*first, "dr mr", "fox", "Zed")]
    made += [("email", f"{f}{s}{x}{d}@{h}") for f in first[:3] for x in last for s in (".", "", "_") for d in ("", "7") for h in ("a.com", "b.org")]
    made += [("email", f"{f[0]}{x}@{h}") for f in first for x in last for h in ("a.com", "c.net")] + [("email", e) for e in ("@x", "a@", "no", "x@y@z", "12@a.com")]
    made += [("phone", f"1555{n:07d}") for n in range(25)] + [("org", o) for o in ("Gray Fox", "GrayFox", "Fox", "gray", "Acme Inc")]
    made += [("url", u) for u in ("http://grayfox.com", "https://a.b.gray.co.uk/x", "fox.org", "http://me@fox.org:80/?q", "http://1.2.3.4/", "acmeinc", "https://www.foxbo.io#x")] + [("place", "Fox"), ("uuid", "fox")]
    extra = ents(*made)
    entities += extra + extra[:5]
    mentions += [(rng.choice(extra)[0], 10**6 + rng.randint(0, 60)) for _ in range(260)] + [("gone", 1)]
    got = [(r.identity, r.id, r.rule) for r in run(spark, entities, mentions)]
    assert partition(got) == partition(one_by_one(entities, mentions))
    assert len({i for _, i, _ in got}) == len(got)


def test_resolution_of_the_given_texts(spark):
    rows = named_entities(spark, SF).collect()
    entities, mentions = [(r.id, r.kind, r.name) for r in rows], [(r.id, r.event) for r in rows]
    got = run(spark, entities, mentions)
    assert partition([(r.identity, r.id, r.rule) for r in got]) == partition(one_by_one(entities, mentions))
    assert {r.confidence for r in got} <= set(aliases.CONFIDENCE.values())


def test_few_and_null_entities(spark):
    assert run(spark, [], []) == []
    rows = run(spark, [("a", "person_name", None), ("b", None, "X Y"), (None, "email", "x@y.z"), ("c", "email", "q@y.z")], [("c", 1), ("c", 2), ("c", None), ("zz", 3)])
    assert [(r.id, r.rule, r.identity_name, r.confidence) for r in rows] == [("c", "handle_anchor", "q@y.z", 0.6)]
    alone = run(spark, ents(("person", "Alice Smith")), [], least=1)
    assert [(r.identity_name, r.rule) for r in alone] == [("Alice Smith", "anchor")]


def test_lookups(spark):
    rows = ents(("person", "Alice Smith"), ("person", "alice smith"), ("org", "Fox"))
    mentions = spark.createDataFrame([(rows[0][0], 1), (rows[1][0], 1), (rows[1][0], 2), (rows[2][0], 1)], "id string, event long")
    keep = checkpointed(spark)
    members = keep(aliases.resolved(spark.createDataFrame(rows, "id string, kind string, name string"), mentions, keep))
    assert sorted(tuple(r) for r in aliases.events_of_identity(mentions, members).select("event", "mentions").collect()) == [(1, 2), (2, 1)]
    assert aliases.with_identities(mentions, members).where("identity is null").select("id").collect()[0].id == "org:Fox"
    start = spark.createDataFrame([(rows[0][0],), ("org:Fox",)], "id string")
    assert {r.id for r in aliases.same_identity(start, members).collect()} == {r[0] for r in rows}
    assert members.select(F.countDistinct("identity")).first()[0] == 1
