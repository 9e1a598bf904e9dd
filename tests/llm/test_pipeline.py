"""Each stage of the corpus pipeline beside a brute-force version, over rows with nulls, empties, repeats and an extra column."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from brute import components, cut_words, sets_of
from tidelog.llm import mixing, quality_mil

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string"


def rows_of(seed=6, n=240):
    rng = np.random.default_rng(seed)
    words = [f"w{i}a" for i in range(400)]
    passage = [str(w) for w in rng.choice(words, 70)]
    out = []
    for i in range(n):
        own = [str(w) for w in rng.choice(words, int(rng.integers(80, 160)))]
        if i % 5 == 1:
            own = out[int(rng.integers(0, len(out)))][1].split()
            own[3:4] = ["changed"]
        elif i % 5 == 2:
            own[20:20] = passage
        text = " ".join(own)
        out.append((i, "!! ".join(own).upper() + "!!" if i % 4 == 3 else text, "en", f"s{i % 3}", len(text), "kept"))
    out += [out[0], out[0], (2, out[2][1] + " end", "en", "s1", 3, "kept"), (1000, None, None, None, None, None), (1001, "", "en", "s0", 0, None), (None, out[4][1], "en", None, 5, None)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows_of(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 4 != 3), 0) for i in range(240)] + [(None, 1, 0), (9, None, 0), (1001, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def key(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality_drops_what_it_rejects(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.quality(spark, docs, folder)
    judged = quality_mil.judged(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert got.columns == docs.columns and key(got) == key(judged.where("score >= 0.7").select(*docs.columns))
    ids = {r.doc_id for r in got.collect()}
    assert all((i in ids) == (i % 4 != 3) for i in range(240) if i % 5 != 1)


def test_near_duplicates_leave_one_of_each_group(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [r for r in rows_of()]
    sets = [(i, s) for i, t, *_ in rows if i is not None for s in [sets_of(t, 5)]]
    links = [(a, b) for n, (a, s) in enumerate(sets) for b, t in sets[:n] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    comp = components({i for i, _ in sets}, links)
    want = [r for r in dict.fromkeys(rows) if r[0] is None or comp[r[0]] == r[0]]
    got = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert got.columns == docs.columns and key(got) == sorted(want, key=str) and len(want) < 230


def test_repeated_passages_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = cut_words([(r[0], r[1]) for r in rows_of()], 50)
    got = corpus_pipeline.repeated_passages(spark, docs, folder)
    assert got.columns == docs.columns
    mine = Counter((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in got.collect())
    assert mine == Counter((i, hashlib.sha256(b" ".join(kept)).hexdigest()) for i, kept, _ in want)
    assert sum(n for _, _, n in want) > 1000 and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


def test_mix_repeats_as_drawn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rate = {r["__source"]: r.rate for r in mixing.rates(docs).collect()}
    want = Counter()
    for r in rows_of():
        u = int(hashlib.md5(f"17|{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, np.exp(-rate[r[3]])
        c = p
        while c <= u:
            k, p = k + 1, p * rate[r[3]] / (k + 1)
            c += p
        want[r] += k
    assert Counter(map(tuple, corpus_pipeline.mix(spark, docs, folder).collect())) == +want


def test_encode_and_the_whole_run(spark, folder):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = Counter((r.doc_id, r.source, tuple(r.ids), r.n_tokens) for r in corpus_pipeline.encode(spark, docs, folder).collect())
    assert got == Counter((r[0], r[3], tuple(x), len(x)) for r in rows_of() for x in [library.encode_ordinary(r[1] or "")])
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = spark.createDataFrame(stage(spark, step, folder).collect(), stage(spark, step, folder).schema)
    whole = corpus_pipeline.run(spark, folder)
    assert key(whole) == key(step) and whole.count() > 50


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
