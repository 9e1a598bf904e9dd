"""Each operator against a brute-force version, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import re
import struct
import textwrap
import time
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import xxhash
from brute import components, cut_words, sets_of
from pyspark.sql import functions as F

from tidelog.llm import licenses, minhash, mixing, quality_mil, sharding, substring, token_files, topk, vector_dedup
from tidelog.llm.common import Scratch, connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(60)]


def corpus(seed=3, n=60):
    rng = np.random.default_rng(seed)
    base = [" ".join(rng.choice(WORDS, int(rng.integers(1, 80)))) for _ in range(n // 3)]
    texts = []
    for i in range(n):
        words = base[i % len(base)].split()
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = str(rng.choice(WORDS))
        texts.append(" ".join(words).upper() if i % 7 == 0 else " ".join(words))
    texts += ["", "  \n ", "one", "One", "two words", base[0], base[0]]
    return [(i * 3 % 101, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (None, base[0], "en", "s1", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC)


def brute_minhash(rows, k, percent):
    sets = {i: sets_of(t, k) for i, t, *_ in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(ids, links)


@pytest.mark.parametrize("crowd", [16, 2])
def test_minhash(spark, docs, monkeypatch, crowd):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    sets, comp = brute_minhash(corpus(), 3, 85)
    got = minhash.near_duplicates(docs, k=3, percent=85).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r.id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.id]), comp[r.id], comp[r.id] == r.id)
    left = minhash.without_near_duplicates(docs, k=3, percent=85)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(i for i in comp if comp[i] == i)


def test_minhash_tiles_agree_with_pairs():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 40, 120).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[int(rng.integers(0, 25)) :], rng.integers(0, 1 << 40, int(rng.integers(0, 20))).astype(np.uint64)])) for _ in range(40)]
    j = lambda a, b: len(np.intersect1d(a, b)) * 100 >= 85 * len(np.union1d(a, b))
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if j(sets[a], sets[b])}
    assert set(zip(*map(list, minhash.tile_links(sets, 85)))) == want
    assert set(zip(*map(list, minhash.tile_links(sets, 85, 15)))) == {(a, b) for a, b in want if a < 15 <= b}


def test_sketches_fill_every_coordinate():
    for n in (1, 2, 7, 500):
        sketch = minhash.sketches([np.arange(n, dtype=np.uint64) * np.uint64(77)], 120)
        assert (sketch != np.iinfo(np.uint64).max).all()


def test_components_both_ways(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 9] + [(50, 60), (60, 3), (7, 7), (50, 60)]
    want = components({x for e in edges for x in e if e[0] != e[1]}, edges)
    df = spark.createDataFrame(edges, "a long, b long")
    for limit in (1000, 0):
        got = connected_components(df, Scratch(spark, "t"), one_task=limit)
        assert dict(got.collect()) == want
        assert connected_components(df.limit(0), Scratch(spark, "t"), one_task=limit).count() == 0


def vectors(seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(90):
        v = base[i % 12] + rng.normal(size=8) * rng.choice([0, 0.02, 0.08, 0.3])
        rows.append((i * 7 % 97, [float(x) for x in v * rng.choice([1, 3])], int(i % 12 % 3)))
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [1.0] + [None] * 7, 1), (203, [float("nan")] * 8, 1), (204, [1.0] * 8, None), (205, [1.0] * 3, 1), (206, [1.0] * 3, 1), (207, [], 1)]
    return rows


@pytest.mark.parametrize("tile", [1024, 4])
def test_vector_dedup(spark, tile):
    rows = vectors()
    ok = {i: (np.array(v), x) for i, v, x in rows if v and x is not None and all(y is not None and np.isfinite(y) for y in v) and any(v)}
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and cos(ok[a][0], ok[b][0])]
    n, comp = Counter(x for e in links for x in e), components([r[0] for r in rows], links)
    df = spark.createDataFrame([(*r, "clash") for r in rows] + [(None, [1.0] * 8, 1, "clash")], "vec_id long, embedding array<double>, label int, n_links string")
    for r in vector_dedup.near_duplicates(df, tile=tile).collect():
        if r.id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (n[r.id], comp[r.id], comp[r.id] == r.id)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_top_k(spark):
    rows = vectors()
    q = {i: np.floor(64 * np.array(v)).astype(int) for i, v, _ in rows if v and all(y is not None and np.isfinite(y) for y in v)}
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, [1.0] * 8, 1, "x")], "vec_id long, embedding array<double>, label int, rank string")
    for k, tile in ((5, 4096), (20, 16), (200, 16)):
        got = topk.top_k(df, F.col("id") % 20 == 0, k=k, tile=tile, block=3).collect()
        want = []
        for a in (i for i in q if i % 20 == 0):
            best = sorted((-int(q[a] @ q[b]), b) for b in q if b != a and len(q[b]) == len(q[a]))[:k]
            want += [(a, n, b, -s) for n, (s, b) in enumerate(best, 1)]
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_top_k_ties_and_large_integers(spark):
    rows = [(i, [3e9, 2.0]) for i in range(0, 40)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 20, k=3, scale=1.0, tile=8).collect()
    assert [(r.id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, 9 * 10**18 + 4) for i in (0, 1, 2)]


@pytest.mark.parametrize("window, batch, fan, least", [(3, 200, 1024, 16384), (13, 200, 3, 20), (3, 200, 3, 20), (2, 60, 2, 20)])
def test_substring(spark, docs, monkeypatch, window, batch, fan, least):
    """Small batches, groups and fans make packets go through several steps."""
    for name, value in (("BATCH", batch), ("FAN", fan), ("LEAST", least), ("GROUP", least * 4)):
        monkeypatch.setattr(substring, name, value)
    want = [(i, len(kept) + gone, gone, hashlib.sha256(b" ".join(kept)).hexdigest()) for i, kept, gone in cut_words([r[:2] for r in corpus()], window)]
    got = [tuple(r) for r in substring.digests(docs, window).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    cut = substring.deduplicated(docs, window)
    assert cut.columns == docs.columns
    mine = sorted((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in cut.where("doc_id is not null").collect())
    assert mine == sorted((w[0], w[3]) for w in want if w[0] is not None)
    assert substring.digests(docs.limit(0), window).count() == 0


def test_substring_leaves_clean_texts_alone(spark):
    rows = spark.createDataFrame([(1, " a  b\tc d\n"), (2, "x a  b\tc y")], "doc_id long, text string")
    assert dict(substring.deduplicated(rows, 3).collect()) == {1: " a  b\tc d\n", 2: "x y"}


def test_substring_of_one_passage_in_every_text(spark, monkeypatch):
    """A hot passage, very long texts, extra columns, and ids that several rows have."""
    for name, value in (("BATCH", 300), ("FAN", 4), ("LEAST", 50), ("GROUP", 80)):
        monkeypatch.setattr(substring, name, value)
    rng, passage = np.random.default_rng(8), " ".join(f"p{i}" for i in range(20))
    rows = [(int(i), " ".join([*(f"x{n}" for n in rng.integers(0, 10**6, 5)), passage, f"end{k}"]), "c") for k, i in enumerate(rng.integers(5, 60, 150))]
    long = " ".join(f"long{i}" for i in range(5000))
    rows += [(2, long, "c"), (70, "a " + long + " " + passage, "c"), (None, passage, "c"), (None, None, None), (71, None, "c"), (3, passage + " first", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string").repartition(5)
    got = {(r.doc_id, r.text[-9:] if r.text else r.text) for r in substring.deduplicated(df, 13).collect()}
    want = [(i, (t if i is None or i in (2, 3) or t is None else " ".join(w for w in t.split() if not w.startswith("p"))), c) for i, t, c in rows]
    want = [(i, t.replace(long, "").strip() if i == 70 else t, c) for i, t, c in want]
    cut = substring.deduplicated(df, 13)
    assert cut.columns == df.columns
    assert sorted(((r[0], (r[1] or "").strip(), r[2]) for r in cut.collect()), key=str) == sorted(((i, t or "", c) for i, t, c in want), key=str)
    assert got


def test_substring_packets_grow_with_the_batches(spark, monkeypatch):
    monkeypatch.setattr(substring, "BATCH", 500)
    monkeypatch.setattr(substring, "LEAST", 100)
    words = np.random.default_rng(1).integers(0, 50, 80_000)
    made = []
    for n in (1, 4):
        texts = [(i, " ".join(f"w{x}" for x in words[i * 100 : i * 100 + 100])) for i in range(200 * n)]
        df = spark.createDataFrame(texts, "id long, text string").repartition(2).selectExpr("id", "0L AS mark", "text")
        counts = substring.suffix_counts(df, 3)
        first, parts = substring.prefix_groups(counts, 32)
        made.append(substring.suffixes(df, 3, first, parts, 1).count())
        assert counts.sum() == 200 * n * 98
    assert made[1] < 5 * made[0]


def test_prefix_groups_split_only_what_is_large(monkeypatch):
    monkeypatch.setattr(substring, "LEAST", 2000)
    counts = np.ones(np.prod(substring.LEVELS), np.int64)
    counts[:3] = 10_000
    first, parts = substring.prefix_groups(counts, 1000)
    assert parts[:3].tolist() == [5, 5, 5] and (parts[3:] == 1).all() and (np.diff(first) >= 0).all()
    assert first[1] == 5 and np.bincount(first[3:], weights=counts[3:]).max() <= 2000


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    extra = [(900, "Ünïcode İstanbul ΣΑΣ don't 12345 é 世界 🙂   x", "", "", 0), (901, "a" * 3000, "", "", 0)]
    rows = corpus() + extra
    df = spark.createDataFrame(rows, DOC).withColumn("ids", F.lit("clash"))
    out = token_files.written_digests(df, path, 1).collect()
    want = Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, *_ in rows for ids in [library.encode(t or "", add_special_tokens=False).ids + [1]])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    assert token_files.written_digests(df.limit(0), path, 1).count() == 0


def test_word_encoder_with_a_small_memory():
    path = public_tokenizers.path("word_bpe_49k.json")
    small = token_files.WordEncoder(path, keep=5)
    texts = [t or "" for _, t, *_ in corpus()] + ["Don't STOP, e.g. x2y!"]
    texts += [f"a{chr(c)}b {chr(c)} '{chr(c)}" for c in (*range(9, 14), *range(32, 0x260), 0x307, 0x3A3, 0x2028)]
    whole = token_files.WordEncoder(path)
    assert [small.encode([t])[0] for t in texts] == [whole.whole(t) for t in texts] == small.encode(texts)


def test_word_encoder_cuts_parts_as_the_library():
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    pieces = ["'", "s", "t", "re", "ve", "ll", "m", "d", "R", "S", " ", "\n", "5", "½", "²", "é", "É", "ß", "!", "_", "-", "ŉ", "<", "/w>", "</w>", "|", ""]
    texts = ["".join(rng.choice(pieces, n)) for n in rng.integers(0, 30, 5000)]
    texts += ["'street 're're 'l 'll'll ''s !'s s's' don'T 5's '", "'", "'r", "'s", "", "\n", " x", "x "]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""] and encoder.encode([" ", "\n"]) == [b"", b""]
    for p in ("a", "'s", "!"):  # no part's end is known: each goes to the library by itself
        encoder.parts.clear()
        encoder.last[:] = False
        assert encoder.encode([p, p + " b"]) == [encoder.whole(p), encoder.whole(p + " b")]


def test_word_encoder_looks_up_distinct_parts_of_a_block_only():
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice([*"abcdefgh"], n)) for n in rng.integers(2, 12, 5000)]
    texts = [", ".join(rng.choice(words, 1000)) for _ in range(300)]
    ids = {p: encoder.whole(p) for p in [",", *words]}
    cut = re.compile(r"[a-z]+|[^\sa-z]+")

    def part_by_part():
        return [b"".join(map(ids.get, cut.findall(t.lower()))) for t in texts]

    def least(run):
        took = []
        for _ in range(5):
            start = time.process_time()
            run()
            took.append(time.process_time() - start)
        return min(took)

    assert encoder.encode(texts) == part_by_part()
    assert least(lambda: encoder.encode(texts)) < least(part_by_part)


def test_token_files_with_rows_beyond_a_block(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = token_files.WordEncoder(path).whole
    texts = [None, "", "two words " * 60_000, "It's 5!", None, "ñandú " * 200_000, "c" * 70_000, ""] * 3
    out = token_files.written_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path, 1).collect()
    want = {t: whole(t or "") + b"\1\0\0\0" for t in set(texts)}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in out} == {(i, len(want[t]) // 4, zlib.crc32(want[t])) for i, t in enumerate(texts)}


def test_sharding(spark, docs):
    out = sharding.sharded(docs, shards=3, slots=64).collect()
    assert len(out) == len(corpus())
    texts = {i: t for i, t, *_ in corpus()}
    for s in range(3):
        places = sorted(r.slot for r in out if r.shard == s)
        assert places == list(range(len(places)))
    for r in out:
        text = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None)
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(3)]
    assert max(sizes) < 1.25 * min(sizes)
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_rebalancing_moves_little(spark, tmp_path):
    rng = np.random.default_rng(2)
    weights = {i: int(w) for i, w in enumerate(rng.integers(50, 150, 512))}
    old = sharding.packed(weights, 8)
    new = sharding.rebalanced(old, weights, 9)
    loads = Counter()
    for slot, shard in new.items():
        loads[shard] += weights[slot]
    moved = [s for s in old if old[s] != new[s]]
    assert max(loads.values()) < 1.05 * min(loads.values()) and len(moved) < 512 / 9 * 1.5 and sum(new[s] != 8 for s in moved) <= 1
    stored = sharding.SlotMap(spark, str(tmp_path))
    stored.save(1, old)
    stored.save(2, new)
    assert dict(stored.load(1).collect()) == old and dict(stored.load(2).collect()) == new


def test_mixing(spark, docs):
    table = {r["__source"]: r.rate for r in mixing.rates(docs, alpha=0.5).collect()}
    weight = {}
    for i, t, _, s, _ in corpus():
        weight[s] = weight.get(s, 0) + len((t or "").encode()) + 1
    total, roots = sum(weight.values()), sum(w**0.5 for w in weight.values())
    assert all(abs(table[s] - w**0.5 / roots * total / w) < 1e-9 for s, w in weight.items())
    out = mixing.mixed(docs, alpha=0.5)
    again = mixing.mixed(docs.repartition(7), alpha=0.5)
    key = lambda df: sorted(((r.doc_id, r.text, r.copy_no, r.n_copies) for r in df.collect()), key=str)
    assert key(out) == key(again)
    for i, t, _, s, _ in corpus():
        u = int(hashlib.md5(f"17|{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, np.exp(-table[s])
        c = p
        while c <= u:
            k += 1
            p *= table[s] / k
            c += p
        got = [r.copy_no for r in out.collect() if r.doc_id == i and r.text == t]
        assert len(got) % max(k, 1) == 0 and (len(got) > 0) == (k > 0)
    assert mixing.mixed(docs.limit(0)).count() == 0
    fixed = {r["__source"]: r.rate for r in mixing.rates(docs, weights={"s0": 1.0}).collect()}
    assert fixed["s1"] == 0 and fixed[None] == 0 and fixed["s0"] > 1


def test_poisson_counts_have_the_target_mean(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 3000, "big").otherwise("small").alias("source"))
    out = mixing.mixed(rows, weights={"big": 1.0, "small": 1.0}).groupBy("source").count().collect()
    assert all(abs(r["count"] - 2000) < 5 * 2000**0.5 for r in out)


def test_licenses(spark, docs):
    texts = {1: "intro words\nReleased under the MIT License.\nmore", 2: "licensed UNDER cc by-nc 4.0", 3: None, 4: "", 5: "License", 6: "released under\nthe mit\nlicense", 7: "This work is licensed under the GNU General Public License, version 3."}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, best_license string")
    got = {r.doc_id: (r.best_license, r.best_dice) for r in licenses.scanned(df).collect()}
    assert got == {1: ("MIT", 1.0), 2: ("CC-BY-NC-4.0", 1.0), 3: (None, None), 4: (None, None), 5: (None, None), 6: ("MIT", 1.0), 7: ("GPL-3.0", 1.0)}
    assert licenses.scanned(docs).count() == len(corpus()) and licenses.scanned(docs.limit(0)).count() == 0


def test_licenses_inside_longer_texts(spark):
    notice = {name: text for name, text in licenses.TEMPLATES}
    full = dict(licenses.TEXTS)
    prose = "The hen and the goat went to the fair of the town, and the fox stayed in the house with the owl.\n" * 40
    wrapped = lambda text, mark="# ": "\n".join(mark + x for x in textwrap.wrap(text, 60))
    texts = {
        1: ("MIT", "import os\n" + wrapped(notice["MIT"]) + "\n" + prose),
        2: ("BSD-3-Clause", prose + wrapped(full["BSD-3-Clause"], " * ") + "\n" + prose),
        3: ("GPL-3.0", prose + wrapped(notice["GPL-3.0"], "// ") + "\n" + prose),
        4: ("MPL-2.0", "Read this first. " + notice["MPL-2.0"] + " " + prose.replace("\n", " ")),
        5: ("MIT", wrapped(full["MIT"], "")),
        6: ("GPL-2.0", prose + wrapped(full["GPL-2.0"], "")),
        7: ("GPL-3.0", full["GPL-3.0"]),
        8: ("Apache-2.0", "x y\n" + full["Apache-2.0"] + prose),
        9: (None, prose),
        10: (None, prose + " ".join(notice["MIT"].split()[:30]) + " " + prose),
    }
    df = spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.best_license, r.n_matches > 0) for r in licenses.scanned(df).collect()}
    assert got == {i: (name, name is not None) for i, (name, _) in texts.items()}


def test_license_runs_lose_nothing(spark):
    """Every run of words, by brute force."""
    rng, words = np.random.default_rng(7), "a b c d e f g h".split()
    template = "a b c d e f g h a c"
    texts = [" ".join(rng.choice(words[: rng.integers(4, 9)], 6)) + "\n" + template[: rng.integers(8, 20)] + " " + " ".join(rng.choice(words, 6)) for _ in range(60)]

    def best(text):
        row, known = licenses._row_of(text), set(licenses.bigrams_of(template))
        runs = [set(row[i:j]) for i in range(len(row)) for j in range(i + 1, min(len(row), i + int(9 * 1.5)) + 1)]
        return max((d for d in (2 * len(r & known) / (len(r) + len(known)) for r in runs) if d >= 0.8), default=None)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.best_dice for r in licenses.scanned(df, templates=(), texts=(("T", template),)).collect()}
    want = {i: best(t) for i, t in enumerate(texts)}
    assert got == {i: d if d is None else round(d, 6) for i, d in want.items()} and any(want.values()) and not all(want.values())


def test_license_bounds_lose_nothing():
    for size in range(1, 60):
        low, high = licenses.bounds(size, 0.8)
        for n in range(1, 120):
            can = 2 * min(size, n) / (size + n) >= 0.8
            assert can == (low <= n <= high)


def test_quality(spark):
    good = ["The hen and the goat went to a fair, and the fox stayed at home with the owl."] * 3
    rows, labels = [], []
    rng = np.random.default_rng(4)
    for i in range(400):
        words = list(rng.permutation(" ".join(good).split()))
        bad = i % 3 == 0
        text = " ".join(f"{w.upper()}!!" for w in words) if bad else " ".join(words)
        rows.append((i, text * (1 + i % 4), "x"))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "words", "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_mil.judged(docs, labels).collect()
    assert len(out) == len(rows)
    truth = {i: int(i % 3 != 0) for i in range(400)}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    none = quality_mil.judged(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_mil.judged(docs.limit(0), labels).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, starts, y = rng.normal(size=(9, 5)), np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0])
    model = quality_mil.GatedAttention(np.zeros(5), np.ones(5), hidden=4, gates=3)
    loss = lambda: -np.mean(y * np.log((s := model.forward(x, starts)["score"])) + (1 - y) * np.log(1 - s))
    grads = model.gradients(model.forward(x, starts), starts, y, 0.0)
    for k, p in model.p.items():
        at = np.unravel_index(p.size // 2, p.shape)
        keep = p[at]
        p[at] = keep + 1e-6
        up = loss()
        p[at] = keep - 1e-6
        down = loss()
        p[at] = keep
        assert abs((up - down) / 2e-6 - grads[k][at]) < 1e-6


def test_minhash_links_both_texts_of_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (1, a), (4, "c " * 9), (5, None), (6, b + " even more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in minhash.near_duplicates(df, k=3, percent=85).collect():
        assert (r.component_id, r.kept) == ((1, r.id == 1) if r.id in (1, 2, 3, 6) else (r.id, True))
    left = minhash.without_near_duplicates(df, k=3, percent=85).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, a), (1, b), (4, "c " * 9), (5, None)], key=str)


def test_minhash_recall_on_the_given_documents(spark):
    """Every pair at the threshold, by the inverted index of all shingles."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets, comp = brute_minhash([(r.doc_id, r.text) for r in df.collect()], 5, 80)
    got = {r.id: r.component_id for r in minhash.near_duplicates(df, k=5, percent=80, bands=30, rows=4).collect()}
    assert got == comp


def test_mixing_has_no_largest_rate(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "x").otherwise("y" * 100).alias("text"), F.when(F.col("id") == 0, "rare").otherwise("big").alias("source"), F.lit(1).alias("n_copies"))
    weights = {"rare": 1.0, "big": 1.0}
    rate = {r["__source"]: r.rate for r in mixing.rates(rows, weights=weights).collect()}["rare"]
    assert rate == pytest.approx(0.5 * (2 + 199 * 101) / 2)
    out = mixing.mixed(rows, weights=weights).where("source = 'rare'").collect()
    assert abs(len(out) - rate) < 5 * rate**0.5 and sorted(r.copy_no for r in out) == list(range(1, len(out) + 1))
    assert {r.n_copies for r in out} == {len(out)}


def test_mixing_by_shuffled_salted_sources(spark, docs, monkeypatch):
    key = lambda df: sorted(((r.doc_id, r.text, r.copy_no) for r in df.collect()), key=str)
    want = key(mixing.mixed(docs))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert key(mixing.mixed(docs)) == want


def test_token_files_with_added_tokens_and_lookup(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["x <|endoftext|> y", "<|startoftext|>", "a<|ENDOFTEXT|>b", "plain words", "<|endoftext", None]
    rows = [(i * 10, t) for i, t in enumerate(texts)] + [(10, "another text of ten")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark, "t")
    out_dir = scratch.path("orc")
    token_files.write(df, path, out_dir, 1)
    got = Counter((r.doc_id, tuple(r.ids)) for r in token_files.read(spark, out_dir).collect())
    assert got == Counter((i, (*library.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in rows)
    assert token_files.WordEncoder(path).splits
    found = token_files.lookup(spark, out_dir, [10, 30])
    assert sorted(r.doc_id for r in found.collect()) == [10, 10, 30]
    assert "PushedFilters: [In(doc_id, [10,30])]" in found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_top_k_of_repeated_query_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 3.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, k=5, scale=1.0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2, 3), (0, 2, 1, 1)]


@pytest.mark.parametrize("n_axes", [1, 3, 5])
def test_vector_dedup_with_other_cells(spark, n_axes):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    key = lambda out: sorted(map(tuple, out.collect()))
    assert key(vector_dedup.near_duplicates(df, tile=4, n_axes=n_axes)) == key(vector_dedup.near_duplicates(df))


def test_quality_of_repeated_ids_and_long_texts(spark):
    rows = [(i, ("good text here. " if i % 2 else "BAD!! ") * (3000 if i == 5 else 8)) for i in range(80)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    assert quality_mil.fit(docs, labels, sample_passages=50) is not None
    out = quality_mil.judged(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in out) and len(out) == 160


def test_sharding_of_a_group_over_half_a_shard(spark):
    rows = [(i, "hot text", "s") for i in range(900)] + [(i, f"text {i}", "s") for i in range(900, 1500)] + [(1, "hot text", "s"), (None, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.sharded(df, shards=4, slots=512).collect()
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(4)]
    assert len(out) == len(rows) and max(sizes) < 1.05 * min(sizes)
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in range(4))


def test_licenses_with_ties_repeats_and_long_texts(spark):
    long = "word " * 30_000
    rows = [(1, "Released under the MIT License.\nLicensed under CC BY 4.0."), (1, "Released under the MIT License.\nLicensed under CC BY 4.0."), (2, long + "\nReleased under the MIT License."), (None, "Released under the MIT License.")]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.licenses, r.best_license) for r in got) == [(0, "MIT", "MIT"), (1, "CC-BY-4.0,MIT", "CC-BY-4.0"), (1, "CC-BY-4.0,MIT", "CC-BY-4.0"), (2, "MIT", "MIT")]


def plain_passages(text):
    """The features of each passage, counted byte by byte."""
    data = (text or "").encode()
    spans, at = [], 0
    for i, b in enumerate(data):  # which word each byte belongs to; blanks go with the word before
        blank = b == 32 or 9 <= b <= 13
        if not blank and (i == 0 or data[i - 1] == 32 or 9 <= data[i - 1] <= 13):
            at += 1
        spans.append(max(at - 1, 0) // quality_mil.PASSAGE_WORDS)
    words = data.split()
    out = []
    for n in range(max(1, -(-len(words) // quality_mil.PASSAGE_WORDS))):
        row = [0.0] * quality_mil.N_FEATURES
        own, part = [i for i, s in enumerate(spans) if s == n], words[n * quality_mil.PASSAGE_WORDS : (n + 1) * quality_mil.PASSAGE_WORDS]
        if words:
            for i in own:
                row[quality_mil.CLASS_OF[data[i]]] += 1 / len(own)
                if i:
                    pair = (data[i - 1] * 257 + data[i]) * 2654435761 % 2**32 >> 27
                    row[quality_mil.N_FEATURES - quality_mil.PAIR_BUCKETS + pair] += 1 / len(own)
            row[quality_mil.N_CLASSES : quality_mil.N_CLASSES + 4] = [len(set(part)) / len(part), sum(a == b for a, b in zip(part, part[1:])) / len(part), sum(map(len, part)) / len(part) / 10, np.log1p(len(part)) / 4]
        out.append(row)
    return np.array(out)


def test_quality_passages_and_forward_by_hand():
    rng = np.random.default_rng(9)
    texts = [None, "", "  ", "one", "a  b\n\nc!", " ".join(rng.choice(["Äh", "word,", "x1", "(y)"], 200)), "z " * 64, "z " * 65]
    for text in texts:
        assert np.allclose(quality_mil.passages(text), plain_passages(text), atol=1e-6)
    bags = [quality_mil.passages(t) for t in texts]
    flat = np.concatenate(bags)
    model = quality_mil.GatedAttention(flat.mean(axis=0, dtype=np.float64), flat.std(axis=0, dtype=np.float64) + 1e-3)
    got = model.forward(flat, np.cumsum([0, *map(len, bags)])[:-1])["score"]
    for bag, score in zip(bags, got):
        p, hidden, weights = model.p, [], []
        for x in bag:
            h = np.tanh(((x - model.mean) / model.std) @ p["W"] + p["b"])
            hidden.append(h)
            weights.append(np.exp(np.sum(p["w"] * np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"]))))))
        z = sum(w * h for w, h in zip(weights, hidden)) / sum(weights)
        assert score == pytest.approx(1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))))


def test_quality_with_a_long_text_first_in_the_order(spark):
    ids = [r[0] for r in spark.range(400).select("id").where(~quality_mil.held_out("id")).orderBy(F.xxhash64("id"), "id").limit(41).collect()]
    good, bad = "The quiet harbour kept its boats until morning came. ", "!!! $$$ ### %%% "
    rows = [(i, (good if n % 2 else bad) * (900 if n == 0 else 2)) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, quality int")
    assert len(quality_mil.passages(rows[0][1])) > 45
    got = {r.doc_id: r.predicted for r in quality_mil.judged(docs, labels, sample_passages=45).collect()}
    assert [got[i] for i in ids] == [n % 2 for n in range(41)]
    bag = np.arange(10)[:, None]
    assert quality_mil.spaced(bag, 4)[:, 0].tolist() == [0, 2, 5, 7] and quality_mil.spaced(bag, 10) is bag


def plain_shards(rows, shards, slots):
    """(id, crc) -> (virtual slot, shard, edited shard), from the rows (id, text) alone."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of_text = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), seed=42))
    of_longs = lambda *v: signed(reduce(lambda seed, x: seed if x is None else xxhash.xxh64_intdigest(struct.pack("<q", x), seed=seed), v, 42))
    records = [(i, (t or ""), of_text(t or ""), len((t or "").encode()) + 1) for i, t in rows]
    by_group = Counter()
    n_group = Counter()
    for _, _, g, size in records:
        by_group[g] += size
        n_group[g] += 1
    total = sum(by_group.values())
    large = {g for g in by_group if by_group[g] > total / (2 * shards) or n_group[g] > len(rows) / (2 * shards)}
    slot = {(i, t): of_longs(g, i) % slots if g in large else of_longs(g) % slots for i, t, g, _ in records}
    weight = Counter()
    for i, t, _, size in records:
        weight[slot[i, t]] += size
    loads, place = [0] * shards, {}
    for s, w in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
        place[s] = min(range(shards), key=lambda k: (loads[k], k))
        loads[place[s]] += w
    return slot, place, weight


def test_sharding_by_hand(spark):
    """Sizes, slots and both maps recomputed; many empty and null texts, which are heavy by rows alone."""
    rows = [(i, "" if i % 3 else None) for i in range(600)] + [(i, f"text {i} " * (i % 40)) for i in range(600, 900)] + [(None, "x"), (None, ""), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.sharded(df, shards=4, slots=256).collect()
    slot, place, weight = plain_shards(rows, 4, 256)
    by_crc = {(i, zlib.crc32((t or "").encode())): s for (i, t), s in slot.items()}
    assert len(out) == len(rows)
    for r in out:
        assert r.virtual_slot == by_crc[r.doc_id, r.text_crc32] and r.shard == place[r.virtual_slot]
    assert max(Counter(r.virtual_slot for r in out).values()) < 40
    edited = sharding.rebalanced(place, weight, 5)
    assert all(r.edited_shard == edited[r.virtual_slot] for r in out)
    moved = {r.virtual_slot for r in out if r.edited_shard != r.shard}
    assert {edited[s] for s in moved} == {4} and sum(weight[s] for s in moved) < 1.2 * sum(weight.values()) / 5


def test_licenses_of_many_short_stretches(spark):
    """A full text with a mark at the head of each line, and a very long text of stretches too thin to match."""
    gpl = dict(licenses.TEXTS)["GPL-3.0"]
    marked = "\n".join(f"dnl {x}" for x in gpl.split("\n"))
    words = gpl.split()
    thin = " ".join(" ".join((*words[i % len(words) : i % len(words) + 2], f"x{i}", f"y{i}", f"z{i}")) for i in range(40_000))
    docs = spark.createDataFrame([(1, gpl, "a"), (2, marked, "a"), (3, thin, "a")], "doc_id long, text string, licenses string").repartition(3)
    got = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    assert all(got[i].licenses == "GPL-3.0" for i in (1, 2)) and got[3].n_matches == 0
    pairs = set(licenses.bigrams_of(gpl))
    own = licenses._row_of(marked)
    first, last = (next(i for i in order if own[i] in pairs) for order in (range(len(own)), range(len(own) - 1, -1, -1)))
    run = set(own[first : last + 1])
    assert got[2].best_dice >= round(2 * len(run & pairs) / (len(run) + len(pairs)), 6)
    assert licenses.scanned(docs.limit(0)).collect() == []
