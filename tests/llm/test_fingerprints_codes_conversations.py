"""Fingerprints, vector codes and conversation repair against plain versions, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import conversations, fingerprints, vector_codes

# Fingerprints


def plain_print(text):
    """The narrow and wide sums, byte by byte."""
    wide, narrow = [0] * fingerprints.WIDE, [0] * fingerprints.NARROW
    for line in text.encode().split(b"\n"):
        raw = hashlib.shake_128(line).digest(8 * fingerprints.WIDE)
        wide = [(w + int.from_bytes(raw[i * 8 : i * 8 + 8], "little")) % 2**64 for i, w in enumerate(wide)]
        padded = bytes(7) + line
        for i in range(len(line)):
            x = int.from_bytes(padded[i : i + 8], "little")
            x ^= x >> 30
            x = x * 0xBF58476D1CE4E5B9 % 2**64
            x ^= x >> 27
            x = x * 0x94D049BB133111EB % 2**64
            x ^= x >> 31
            if padded[i + 7]:
                narrow[x % 128] += -1 if x >> 7 & 1 else 1
    return b"".join(w.to_bytes(8, "little") for w in wide) + b"".join(n.to_bytes(4, "little", signed=True) for n in narrow)


def plain_edits(rows):
    out = []
    for i, (key, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        new = text[: len(text) - k] + following[:k]
        a, b, c = (fingerprints.from_bytes(plain_print(x)) for x in (text, new, following))
        out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), plain_print(text).hex(), plain_print(new).hex(), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return out


@pytest.mark.parametrize("ranges", [None, 1, 3])
def test_edits(spark, ranges):
    rng = random.Random(5)
    rows = [(i * 7 % 211 - 40, "\n".join(" ".join(rng.choice(["é", "ab", "longer", "字字", "x\0y"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "\n\n\n\n"), (503, "abc"), (504, "z" * 3000), (505, rows[0][1])]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, n_chars string, fingerprint string").repartition(7)
    got = fingerprints.edits(docs, ranges=ranges).collect()
    assert sorted(map(tuple, got)) == sorted(plain_edits(sorted(rows)))


def test_edits_of_few_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert fingerprints.edits(spark.createDataFrame([], schema)).collect() == []
    one = fingerprints.edits(spark.createDataFrame([(9, "abcdefgh")], schema)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    same = fingerprints.edits(spark.createDataFrame([(1, "aaaabbbb")] * 5 + [(None, "ccccdddd")], schema)).collect()
    shas = [hashlib.sha256(x).hexdigest() for x in (b"aaaabbaa", b"aaaabbcc", b"ccccddaa")]
    assert sorted(r.edited_sha256 for r in same) == sorted([shas[0]] * 4 + shas[1:])
    assert [r.doc_id for r in same if r.edited_sha256 == shas[2]] == [None]


def test_long_texts_in_blocks(monkeypatch):
    text = "\n".join(["word " * n for n in range(60)] + ["", "x" * 2000, ""] + ["tail"] * 50)
    monkeypatch.setattr(fingerprints, "BLOCK", 64)
    assert fingerprints.to_bytes(fingerprints.of_text(text.encode())) == plain_print(text)


def test_sums_of_fingerprints(spark):
    lines = ["one line", "", "another", "one line", "third\ttab"]
    of = lambda *x: fingerprints.to_bytes(fingerprints.of_text("\n".join(x).encode()))
    assert of(*lines) == of(*reversed(lines)) and of(*lines) != of(*lines[1:])
    rows = spark.createDataFrame([("a", x, 1) for x in lines] + [("a", "late", 1), ("a", "late", -1), (None, "z", 1), ("b", None, 1)], "key string, text string, sign int").repartition(3)
    made = fingerprints.fingerprinted(rows.where("text is not null or key = 'b'").withColumn("fingerprint", F.lit(0)))
    got = {r.key: bytes(r.fingerprint) for r in fingerprints.combined(made, "key", sign_col="sign").collect()}
    assert got == {"a": of(*lines), None: of("z"), "b": of("")}
    whole = fingerprints.of_text(b"one\ntwo\nthree")
    assert fingerprints.to_bytes(fingerprints.replaced(whole, b"two\nthree", b"four")) == of("one", "four")


def test_likeness_follows_shared_text():
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    base = words(400)
    near = [fingerprints.likeness(*(fingerprints.of_text(x.encode()) for x in (base, base[: int(len(base) * keep)] + words(int(400 * (1 - keep)))))) for keep in (1, 0.9, 0.75, 0.5, 0)]
    assert near == sorted(near, reverse=True) and near[0] == 1 and abs(near[2] - 0.75) < 0.2 and near[4] < 0.3


# Vector codes


def plain_codes(rows, parts, entries, rounds):
    kept = sorted((i is None, i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    out, total = [], defaultdict(int)
    for d in {len(v) for _, _, v, _ in kept}:
        own = [r for r in kept if len(r[2]) == d]
        cut = lambda v, p: v[p * d // parts : (p + 1) * d // parts]  # noqa: B023, E731
        books = [[cut(r[2], p) for r in own[:entries]] for p in range(parts)]
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        nearest = lambda v, p: min((far(cut(v, p), e), i) for i, e in enumerate(books[p]))[::-1]  # noqa: B023, E731
        for _ in range(rounds):
            new = []
            for p in range(parts):
                groups = defaultdict(list)
                for r in own:
                    groups[nearest(r[2], p)[0]].append(cut(r[2], p))
                new.append([[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])])
            books = new
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for _, i, v, label in own:
            found = [nearest(v, p) for p in range(parts)]
            error = sum(e for _, e in found)
            total[label] += error
            out.append([i, "".join(f"{c:02x}" for c, _ in found), error, label, sha])
    return sorted(((i, code, error, total[label], sha) for i, code, error, label, sha in out), key=str)


def test_vector_codes(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i) * 5 % 97, [float(x) for x in rng.normal(0, 1, 8).round(2)], int(i) % 3 if i % 5 else None) for i in range(90)]
    rows += [(3, [0.0] * 8, 1), (3, [0.0] * 8, 1), (200, None, 1), (201, [1.0, None] * 4, 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] + [0.0] * 7, 1), (None, [0.5] * 8, 2)]
    rows += [(300 + i, [float(x) for x in rng.normal(0, 1, 4).round(1)], 0) for i in range(9)] + [(400, [], 1), (401, [-1.0, 2.0, 0.25, 0.1, 7.0], None)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(6)
    want = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = vector_codes.digests(vectors, parts=4, entries=5, rounds=2)
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(want, 4, 5, 2)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_vector_codes_of_few_rows_ties_and_refusals(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert vector_codes.digests(spark.createDataFrame([], schema)).collect() == []
    two = spark.createDataFrame([(7, [0.5] * 16, None), (8, [0.5] * 16, None)], schema)
    assert {(r.code, r.error, r.label_error) for r in vector_codes.digests(two).collect()} == {("00" * 16, 0, 0)}
    with pytest.raises(Exception, match="after scaling"):
        vector_codes.digests(spark.createDataFrame([(1, [1e9] * 16, 0)], schema)).collect()
    books = vector_codes.trained(vector_codes.usable(two, "vec_id", "embedding", "label"))
    codes = vector_codes.encoded(vector_codes.usable(two, "vec_id", "embedding", "label"), books)
    assert all(abs(x - 0.5) < 1 / 256 for r in vector_codes.decoded(codes, books).collect() for x in r.vector)


# Conversations

FAULTS = ["", "blank", "duplicate", "cut"]


def plain_repair(rows):
    """The least (cost, labels) over all edit sequences, with whole label strings; rows of (role, fault)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserted):
        ways = [(0, "")] if i == len(rows) and last in ("", "a") else []
        put = lambda cost, label, rest: ways.append((rest[0] + cost, label + rest[1])) if rest else None
        for role in after[last].replace("s", ""):
            if inserted < 3:
                put(2, "I", best(i, role, inserted + 1))
        if i < len(rows):
            role, fault = rows[i]
            put(3, "D", best(i + 1, last, 0))
            if fault not in ("blank", "duplicate"):
                more = fault == "cut"
                if role[:1] and role[:1] in after[last]:
                    put(more, "K", best(i + 1, role[:1], 0))
                for new in after[last].replace("s", ""):
                    put(2 + more, "R", best(i + 1, new, 0))
        return min(ways, default=None)

    return best(0, "", 0)


def test_repairs_are_the_cheapest():
    rng = random.Random(8)
    for _ in range(3000):
        kinds = [4 * rng.randint(0, 3) + rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randint(0, 9))]
        assert conversations.repair(kinds) == plain_repair([("sua-"[k // 4], FAULTS[k % 4]) for k in kinds])


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else shown(role), "" if kind == 1 else shown(text)
        text = text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_digests(original, rows):
    """rows: after damage."""
    out = []
    for conv in {r[0] for r in original}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "cut"
            seen.add((role, text))
            marked.append((role, fault))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = plain_repair(marked)
        said, at, last = [], 0, ""
        for label in audit:
            new = "assistant" if last == "u" else "user"
            if label == "I":
                said.append((new, ""))
            elif label in "KR":
                said.append((own[at][1] if label == "K" else new, own[at][2]))
            at += label != "I"
            last = said[-1][0][0] if said else ""
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        n = lambda f: sum(x == f for _, x in marked)  # noqa: B023, E731
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((conv, gaps, n("blank"), n("duplicate"), n("cut"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return sorted(out, key=str)


def talks(seed, n):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"], ["Well.", "Yes!", "no end", "  ", "", None, "Again?\n", "a.b!c", " ", "Äh. ", "字。"]
    rows = []
    for conv in [None, *range(n)]:
        for turn in [None, *range(-1, rng.randint(0, 12))]:
            if rng.random() < 0.85:
                rows += [(conv, turn, rng.choice(roles), rng.choice(texts))] * rng.choice([1, 1, 1, 2])
    return rows


SAID = "conv_id long, turn long, role string, text string"


def test_damaged_conversations(spark):
    rows = talks(3, 60)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SAID + ", gaps int, kind string").repartition(5)
    got = conversations.digests(conversations.damaged(frame)).collect()
    assert sorted(map(tuple, got), key=str) == plain_digests(rows, plain_damage(rows))


def test_conversations_as_they_are(spark):
    rows = talks(4, 25)
    rows += [(900, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(800)] + [(901, 5, "user", "long " * 60_000 + ".")]
    frame = spark.createDataFrame(rows, SAID).repartition(5)
    shown = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    got = conversations.digests(conversations.as_they_are(frame)).collect()
    few = [r for r in shown if r[0] != 900]
    assert sorted((tuple(r) for r in got if r.conv_id != 900), key=str) == plain_digests(few, few)
    assert [(r.cost, r.audit) for r in got if r.conv_id == 900] == [(0, "K" * 800)]
    fixed = conversations.repaired(conversations.as_they_are(frame)).collect()
    said = defaultdict(list)
    for r in sorted(fixed, key=lambda r: r.place):
        said[r.conv].append(r)
    for conv, own in said.items():
        assert [r.place for r in own] == list(range(len(own)))
        order = "".join(r.role[0] for r in own)
        assert order.removeprefix("s").replace("ua", "") == ""
    shas = {r.conv_id: r.repaired_sha256 for r in got}
    assert {c: hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in said.get(c, [])).encode()).hexdigest() for c in shas} == shas


def test_no_conversations(spark):
    assert conversations.digests(conversations.damaged(spark.createDataFrame([], SAID))).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = conversations.digests(conversations.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], SAID))).first()
    assert tuple(got) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
