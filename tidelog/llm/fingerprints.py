"""Document fingerprints by a homomorphic multiset hash.

A paragraph (a line of the text, empty ones too) is hashed to a wide vector: 16
lanes of 64 bits, drawn from all its bytes, and 128 lanes of 32 bits, to which
every window of 8 bytes of the paragraph, padded in front, adds 1 or takes 1 off
in a lane that the window's hash names.  A text's fingerprint is the sum of its
paragraphs' vectors, each lane modulo the power of two of its width.  So the
order of paragraphs doesn't matter, paragraphs are put in or taken out by adding
or subtracting their vectors, and fingerprints of parts add up to the whole's.

The wide lanes tell different multisets of paragraphs apart: two have the same
sums with a chance of about 2**-1024.  The narrow lanes are a signed count sketch
of the windows: the cosine of two of them estimates the cosine of the texts'
window counts to within some 0.09, and is the likeness of two fingerprints, held
to 0 to 1; 1 for equal fingerprints, and 0 where just one has no windows.

`edits` compares each text with an edited version, whose end is replaced by the
beginning of the next document in the order of ids.  The edited fingerprint is
made from the text's by taking out the paragraphs that the edit touches and
putting in the new ones.  Rows are dealt by ranges of ids, from a bounded sample
of keys, and each range also gets the first row of the range behind it, so a
task sees every row with the next one and holds two texts at a time.

Null texts are empty.  A null id counts as the least; rows with one id are
ordered by a hash of the text.  Repeated rows are rows of their own, each with
the next as its neighbour.  A single row follows itself.  Very long texts count
whole, a block at a time.  Extra columns are left out, whatever their names.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, ready
from tidelog.llm.words import mix

WIDE, NARROW, WINDOW = 16, 128, 8
PAD = b"\0" * (WINDOW - 1)
#: Bytes hashed at a time.
BLOCK = 1 << 18
#: Keys of the sample for each range; bytes of texts of a range; ranges at most.
SAMPLE, RANGE_BYTES, MOST_RANGES = 16, 16 << 20, 65_536

#: A fingerprint as it is worked with: the wide lanes, the narrow lanes.
Print = tuple[np.ndarray, np.ndarray]


def _groups(data: bytes) -> Iterator[bytes]:
    """The text in pieces of whole paragraphs, of some BLOCK bytes unless a paragraph is longer."""
    start = 0
    while len(data) - start > BLOCK and (end := data.find(b"\n", start + BLOCK)) >= 0:
        yield data[start:end]
        start = end + 1
    yield data[start:]


def _windows(padded: bytes) -> np.ndarray:
    """How often each value of sign and lane is drawn; windows that end in a zero byte, as all between paragraphs do, don't count."""
    out = np.zeros(2 * NARROW, np.int64)
    for at in range(0, len(padded) - WINDOW + 1, BLOCK):
        n = min(BLOCK, len(padded) - WINDOW + 1 - at)
        all_of = np.ndarray(n, "<u8", padded, at, (1,))
        real = np.frombuffer(padded, np.uint8, n, at + WINDOW - 1) != 0
        with np.errstate(over="ignore"):
            h = mix(all_of[real])
        out += np.bincount((h & np.uint64(2 * NARROW - 1)).astype(np.int64), minlength=2 * NARROW)
    return out


def of_text(data: bytes) -> Print:
    """The fingerprint of a UTF-8 text."""
    wide, counts = np.zeros(WIDE, np.uint64), np.zeros(2 * NARROW, np.int64)
    for group in _groups(data):
        pieces = group.split(b"\n")
        drawn = b"".join([hashlib.shake_128(p).digest(8 * WIDE) for p in pieces])
        wide += np.frombuffer(drawn, "<u8").reshape(-1, WIDE).sum(axis=0, dtype=np.uint64)
        counts += _windows(PAD + (b"\0" + PAD).join(pieces))
    return wide, (counts[:NARROW] - counts[NARROW:]).astype(np.int32)


def plus(a: Print, b: Print) -> Print:
    with np.errstate(over="ignore"):
        return a[0] + b[0], a[1] + b[1]


def minus(a: Print, b: Print) -> Print:
    with np.errstate(over="ignore"):
        return a[0] - b[0], a[1] - b[1]


def replaced(whole: Print, old: bytes, new: bytes) -> Print:
    """The fingerprint after the paragraphs of `old` went and those of `new` came."""
    return plus(minus(whole, of_text(old)), of_text(new))


def to_bytes(a: Print) -> bytes:
    return a[0].astype("<u8").tobytes() + a[1].astype("<i4").tobytes()


def from_bytes(raw: bytes) -> Print:
    return np.frombuffer(raw[: 8 * WIDE], "<u8"), np.frombuffer(raw[8 * WIDE :], "<i4")


def likeness(a: Print, b: Print) -> float:
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    xx, yy = x @ x, y @ y
    if not xx or not yy:
        return 1.0 if xx == yy else 0.0
    return float(min(1.0, max(0.0, x @ y / np.sqrt(xx * yy))))


def fingerprinted(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a binary column `out`: the fingerprint of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [to_bytes(of_text(x.as_buffer().to_pybytes() if x.is_valid else b"")) for x in batch.column(len(batch.columns) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names)

    ready(docs.sparkSession)
    kept = [f for f in docs.schema if f.name != out]
    names = [*(f.name for f in kept), out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` binary"])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text_col).cast("string").cast("binary").alias(f"__{out}")).mapInArrow(run, schema)


def combined(rows: DataFrame, key_col: str, fingerprint_col: str = "fingerprint", sign_col: str | None = None) -> DataFrame:
    """(key, fingerprint): the sums of fingerprints with one key; rows whose sign is negative are taken off.

    For documents kept in parts, for whole sources, or to bring stored
    fingerprints up to date.  Each task sums up its own rows first, so a key
    that a third of all rows hold costs a row for each batch.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            at = codes.indices.to_numpy()
            wide, narrow = np.zeros((len(codes.dictionary), WIDE), np.uint64), np.zeros((len(codes.dictionary), NARROW), np.int32)
            raw = [x.as_py() for x in batch.column(1)]
            known = np.array([i for i, r in enumerate(raw) if r is not None], np.int64)
            if len(known):
                off = (np.asarray(batch.column(2)) < 0)[known]
                prints = [from_bytes(raw[i]) for i in known]
                w, n = np.stack([p[0] for p in prints]).astype(np.uint64), np.stack([p[1] for p in prints]).astype(np.int32)
                with np.errstate(over="ignore"):
                    w[off], n[off] = np.uint64(0) - w[off], -n[off]
                    np.add.at(wide, at[known], w)
                    np.add.at(narrow, at[known], n)
            yield pa.RecordBatch.from_arrays([codes.dictionary, pa.array([to_bytes(p) for p in zip(wide, narrow)], pa.binary()), pa.array(np.ones(len(wide), np.int32))], names)

    ready(rows.sparkSession)
    names = [key_col, "fingerprint", "sign"]
    kind = rows.schema[key_col].dataType.simpleString()
    sign = F.lit(1) if sign_col is None else F.coalesce(F.col(sign_col), F.lit(1))
    own = rows.select(F.col(key_col), F.col(fingerprint_col).alias("fingerprint"), sign.cast("int").alias("sign"))
    schema = f"`{key_col}` {kind}, fingerprint binary, sign int"

    def merged(table: pa.Table) -> pa.Table:
        total = [sum_of for batch in table.combine_chunks().to_batches() for sum_of in partial([batch])]
        return pa.Table.from_batches(total).select([key_col, "fingerprint"])

    once = own.mapInArrow(partial, schema)
    return once.groupBy(key_col).applyInArrow(merged, f"`{key_col}` {kind}, fingerprint binary")


def _bounds(keys: DataFrame, ranges: int | None) -> np.ndarray:
    """First keys of all ranges but the first, from a sample of about SAMPLE keys for each range."""
    rows, size = keys.agg(F.count("*"), F.sum("bytes")).first()
    if ranges is None:
        few = 4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = min(max((size or 0) // RANGE_BYTES, few), MOST_RANGES)
    each = max(1, rows // (SAMPLE * ranges))
    drawn = keys.where(F.pmod(F.xxhash64("id", "hash"), F.lit(each)) == 0).select("id", "hash").distinct().toArrow()  # about SAMPLE * ranges keys
    drawn = np.sort(_keys(drawn.column("id").combine_chunks(), drawn.column("hash").combine_chunks()))
    return drawn[[i * len(drawn) // ranges for i in range(1, ranges)]] if len(drawn) else drawn


def _keys(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
    out = np.zeros(len(ids), [("id", "i8"), ("hash", "i8")])
    out["id"], out["hash"] = ids.to_numpy(), hashes.to_numpy()
    return out


def _dealt(bounds: np.ndarray):
    """(range, id, hash, packed) of (id, hash, text): the range of a row's key, and its text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            at = np.searchsorted(bounds, _keys(*batch.columns[:2]), side="right").astype(np.int32)
            packed = [pack(x.as_buffer()) for x in batch.column(2)] if len(batch.columns) > 2 else [None] * len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns[:2], pa.array(packed, pa.binary())], ["range", "id", "hash", "packed"])

    return run


DEALT = "range int, id long, hash long, packed binary"


def neighbours(docs: DataFrame, id_col: str, text_col: str, ranges: int | None, scratch: Scratch) -> DataFrame:
    """(range, ends, id, hash, packed, null_id): rows to be sorted by range, ends, id and hash; a row that ends a range is the first of the next."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("long")
    keyed = docs.select(F.coalesce(own, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("text"))
    keys = scratch.table(keyed.select("id", "hash", F.octet_length("text").cast("long").alias("bytes")), "keys")
    bounds = _bounds(keys, ranges)
    firsts = keys.select("id", "hash").mapInArrow(_dealt(bounds), DEALT).groupBy("range").agg(F.min(F.struct("id", "hash")).alias("k"))
    firsts = sorted((r["range"], r["k"]["id"], r["k"]["hash"]) for r in firsts.collect())  # a row for each range
    before = [firsts[i - 1][0] for i in range(len(firsts))]  # the last range is before the first
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(to, i, h) for to, (_, i, h) in zip(before, firsts)], "to int, id long, hash long")
    ends = keyed.join(F.broadcast(wanted), ["id", "hash"]).groupBy("to", "id", "hash").agg(F.first("text").alias("text"))
    ends = ends.select("id", "hash", "text").mapInArrow(_dealt(bounds), DEALT).join(F.broadcast(wanted.select("to", "id", "hash")), ["id", "hash"])
    ends = ends.select(F.col("to").alias("range"), F.lit(1).alias("ends"), "id", "hash", "packed")
    rows = keyed.mapInArrow(_dealt(bounds), DEALT).select("range", F.lit(0).alias("ends"), "id", "hash", "packed")
    return rows.unionByName(ends).repartition(max(1, len(firsts)), "range").sortWithinPartitions("range", "ends", "id", "hash")


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter of code points replaced by the beginning of the next, and where the first paragraph that changed begins."""
    kept = len(text) - len(text) // 4
    out = text[:kept] + following[: len(text) // 4]
    return out, text.rfind("\n", 0, kept) + 1 if len(text) >= 4 else len(text)


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint and edited_fingerprint (hex), near_edited, near_next for each row."""
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def pair(key: int | None, text: str, own: Print, following: str, nearby: Print) -> tuple:
        new, at = edited(text, following)
        utf = lambda x: x.encode("utf-8", "surrogatepass")
        if len(text) < 4:  # nothing is replaced
            after = own
        else:
            after = replaced(own, utf(text[at:]), utf(new[at:])) if at else of_text(utf(new))
        sha = hashlib.sha256(utf(new)).hexdigest()
        return key, len(text), sha, to_bytes(own).hex(), to_bytes(after).hex(), likeness(own, after), likeness(own, nearby)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, place = zstandard.ZstdDecompressor().decompress, None, None
        for batch in batches:
            out = []
            for where, ends, key, packed in zip(*(c.to_pylist() for c in batch.columns)):
                data = unpack(packed)
                row = (None if key == -(1 << 63) else key), data.decode("utf-8", "surrogatepass"), of_text(data)
                if last is not None and place == where:
                    out.append(pair(*last, *row[1:]))
                last, place = (None if ends else row), where
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names)

    spark = ready(docs.sparkSession)
    rows = neighbours(docs, id_col, text_col, ranges, scratch or Scratch(spark, "fingerprints"))
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("range", "ends", "id", "packed").mapInArrow(run, schema)
