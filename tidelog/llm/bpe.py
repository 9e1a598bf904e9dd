"""Byte-level BPE as a monoid: encode halves, join neighbours; decode by concatenation.

A node holds exactly the ids of its own text.  A leaf is encoded directly; two
neighbours are joined by encoding anew a window about their border.  Matches
of the splitting pattern are made left to right and look at most LOOK
characters past their end, so the left node's matches stand up to the last one
that begins at least LOOK + 1 characters before its end; from there the window
is matched anew and grows, doubling, until one of its matches ends where a
match of the right node ends, with LOOK characters to spare: matching goes on
from equal places over equal text, so every later id of the right node stands.

Every text goes through the tree, down to leaves of some 50 matches; of a leaf
each match's ids are looked up or, the first time, encoded.

A null text is encoded as an empty one, without ids.  Very long texts make deep
trees of the same leaves; a single match of any length is one leaf's at last.
Repeated rows each give a row; `encoded` and `decoded` keep extra columns, and
overwrite one of the output's name.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import ready

#: Fixed value: the one splitting pattern that LOOK is true of; its matches leave no gap.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters past a match's end on which it can depend: of the pattern's parts only contractions read two.
LOOK = 3
#: Matches whose ids a worker remembers, and the longest of them.
KNOWN, LONGEST = 200_000, 64


class _Pieces(dict):
    """Ids of matches; filled on demand, emptied when full."""

    def __init__(self, piece: Callable[[str], list[int]]):
        self.piece = piece

    def __missing__(self, match: str) -> list[int]:
        ids = self.piece(match)
        if len(match) <= LONGEST:
            if len(self) >= KNOWN:
                self.clear()
            self[match] = ids
        return ids


class TreeCodec:
    """encode and decode over a balanced tree; piece(text) gives the ids of one match of PATTERN."""

    def __init__(self, pattern: str, piece: Callable[[str], list[int]], raw: Callable[[list[int]], bytes], leaf: int = 256, window: int = 32):
        if pattern != PATTERN:
            raise ValueError("how far a match looks ahead is known of one pattern only")
        self.matches, self.raw = regex.compile(pattern).findall, raw
        self.ids_of = _Pieces(piece).__getitem__
        self.leaf, self.window = max(leaf, 2), max(window, 1)

    def encode(self, text: str) -> list[int]:
        return self._node(text)[0]

    def _node(self, text: str) -> tuple[list[int], int, int]:
        """Ids of text; then characters and ids from its last border that no text to the right can move."""
        if len(text) <= self.leaf:
            return self._leaf(text)
        middle = len(text) // 2
        return self.join(text[:middle], self._node(text[:middle]), text[middle:], self._node(text[middle:]))

    def _leaf(self, text: str) -> tuple[list[int], int, int]:
        matches = self.matches(text)
        found = list(map(self.ids_of, matches))
        size = count = 0
        for m, ids in zip(reversed(matches), reversed(found)):
            size, count = size + len(m), count + len(ids)
            if size > LOOK:
                break
        return list(itertools.chain.from_iterable(found)), size, count

    def join(self, left: str, a: tuple[list[int], int, int], right: str, b: tuple[list[int], int, int]) -> tuple[list[int], int, int]:
        """The node of left + right from the nodes of both."""
        text = left[len(left) - a[1] :]
        kept = a[0][: len(a[0]) - a[2]]
        size = self.window
        while size < len(right):
            if found := self._resync(text + right[:size], right[:size], len(text)):
                fresh, skipped, border = found
                if len(right) - b[1] >= border:
                    return kept + fresh + b[0][skipped:], *b[1:]
                break
            size *= 2
        ids, *tail = self._leaf(text + right)
        return kept + ids, *tail

    def _resync(self, joined: str, right: str, offset: int) -> tuple[list[int], int, int] | None:
        """Fresh ids up to a border that both matchings share, how many of the right node's ids they replace, and the border."""
        own, count, n = {0: 0}, 0, 0
        for m in self.matches(right):
            n, count = n + len(m), count + len(self.ids_of(m))
            own[n] = count
        fresh, n = [], -offset
        for m in self.matches(joined):
            n += len(m)
            fresh += self.ids_of(m)
            if n in own and 0 <= n <= len(right) - LOOK - 1:
                return fresh, own[n], n
        return None

    def decode(self, ids: list[int], leaf: int = 1024) -> bytes:
        if len(ids) <= leaf:
            return self.raw(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)


@functools.lru_cache(maxsize=2)
def rank_codec(path: str, pattern: str) -> TreeCodec:
    """The codec of a file of ranks, made once in each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return TreeCodec(pattern, encoding.encode_ordinary, encoding.decode_bytes)


def encoded(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of every whole text as array<int>."""
    ready(docs.sparkSession)
    fields = docs.schema.fieldNames()
    at = fields.index(text_col)
    schema = docs.withColumn(out, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(path, pattern)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                ids = pa.array([codec.encode(x.as_py() or "") for x in part.column(at)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*fields, out])

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the bytes of the ids as binary column; null ids give no bytes."""
    ready(rows.sparkSession)
    fields = rows.schema.fieldNames()
    at = fields.index(ids_col)
    schema = rows.withColumn(out, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(path, pattern)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                data = pa.array([codec.decode(x.as_py() or []) for x in part.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, data], [*fields, out])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids."""
    ready(docs.sparkSession)
    hex_of = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(path, pattern)
        for batch in batches:
            sizes, one, two = [], [], []
            for x in batch.column(1):
                ids = codec.encode(x.as_py() or "")
                sizes.append(len(ids))
                one.append(hex_of(",".join(map(str, ids)).encode()))
                two.append(hex_of(codec.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
