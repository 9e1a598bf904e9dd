"""The tree encoder against the library, and exact round trips."""

import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm.bpe import TreeCodec, decoded, digests, encoded, rank_codec

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = rank_codec(PATH, PATTERN)
SMALL = TreeCodec(PATTERN, LIBRARY.encode_ordinary, LIBRARY.decode_bytes, leaf=4, window=1)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list(" \n\t'slrevdtm1234aZé. ,!ñ世́ 🙂")), max_size=90))
def test_tree_equals_whole(text):
    ids = SMALL.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert SMALL.decode(ids, leaf=3) == text.encode()


def test_long_texts_without_a_break():
    for text in ("a" * 5000, " " * 5000, "'" * 999 + "ll" * 999, "ab " * 4000, "!" * 4097 + "x"):
        assert SMALL.encode(text) == LIBRARY.encode_ordinary(text) == CODEC.encode(text)


def test_other_patterns_are_refused():
    with pytest.raises(ValueError):
        TreeCodec(r"\\S+", LIBRARY.encode_ordinary, LIBRARY.decode_bytes)


def test_documents_equal_the_library(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert all(CODEC.encode(r.text or "") == LIBRARY.encode_ordinary(r.text or "") for r in rows)
    assert all(CODEC.decode(CODEC.encode(r.text or "")) == (r.text or "").encode() for r in rows)


def test_nulls_empties_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "the end's end", "z"), (2, "", "y")], "doc_id long, text string, n_tokens string")
    ids = encoded(rows, PATH, PATTERN)
    got = [(r.doc_id, r.n_tokens, list(r.ids), bytes(r.decoded)) for r in decoded(ids, PATH, PATTERN).collect()]
    assert got[0] == (1, "x", [], b"") and got[1] == got[3] == (2, "y", [], b"")
    assert got[2][3] == b"the end's end"
    assert [r.n_tokens for r in digests(rows, PATH, PATTERN).collect()] == [0, 0, len(got[2][2]), 0]
    assert digests(rows.limit(0), PATH, PATTERN).count() == 0
