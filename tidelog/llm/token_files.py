"""Token ids as ORC files: run-length encoded integers, row indexes, Bloom filters on ids.

Documents are range-partitioned and sorted by id, so files and stripes hold
disjoint id ranges: readers take stripes in parallel, skip by the minima and
maxima of the row index and, for a single id, by the Bloom filter.  Each row
keeps where its ids begin within its file; a file's total gives the rest.

Strings of the tokenizer's added tokens in a text become those tokens' ids, as
the library does it.  `lookup` reads single documents by id: the Bloom filter and
the row index let it skip files and stripes.  Extra columns are not written.

A null text is encoded as an empty one.  Rows with equal ids follow each other,
ordered by a hash of the text, null ids first.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, ready

#: Kinds of characters: a part is a run of one kind, whitespace stands between parts.
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Bytes of text that are split and looked up at once.
BLOCK_BYTES = 1 << 20


def _plain() -> tuple[re.Pattern, np.ndarray]:
    """Texts of plain Latin characters, and the kind of each such character by its code.

    Characters from U+00A1 to U+024F whose lower case is one of these too, but
    for the soft hyphen.
    """
    plain = [c for c in map(chr, range(0xA1, 0x250)) if "\u00a0" < c.lower() < "\u0250" and len(c.lower()) == 1 and c != "\u00ad"]
    text = re.compile("[\\t\\n\\x0b\\x0c\\r\\x20-\\x7e" + "".join(plain) + "]*")
    kinds = {c: {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in [*map(chr, range(0x21, 0x7F)), *plain]}
    return text, np.array([kinds.get(chr(c), SPACE) for c in range(0x250)], np.uint8)


class WordEncoder:
    """Whole-text ids of a tokenizer that splits texts into parts which it encodes one by one.

    Texts of plain Latin characters, on which normalising and lower-casing work
    character by character, are split here, a block of them at once; equal parts
    of a block are found by Arrow, the ids of each distinct part kept.  Any other
    text goes to the library whole, and so do texts that may hold an added token,
    such as <|endoftext|>.  A file whose normaliser or parts are others than
    SPLITS says, or that doesn't mark the ends of parts, has all its texts
    encoded by the library.
    """

    #: The normaliser and the parts on which PLAIN and KINDS rest.
    SPLITS = (
        ("NFC", "Replace", "Lowercase"),
        r"\s+",
        r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    )

    PLAIN, KINDS = _plain()

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        content = json.loads(self.library.to_str())
        steps = (content["normalizer"] or {}).get("normalizers", [])
        parts = (content["pre_tokenizer"] or {}).get("pretokenizers", [])
        regex = lambda x: x.get("pattern", {}).get("Regex")
        found = tuple(s["type"] for s in steps), *(regex(s) for s in steps if s["type"] == "Replace"), *(regex(p) for p in parts if p["type"] == "Split")
        added = [re.escape(t["content"]) for t in content["added_tokens"]]
        self.added = re.compile("|".join(added) if added else r"(?!)", re.IGNORECASE)
        suffix = content["model"].get("end_of_word_suffix")
        self.splits = found == self.SPLITS and bool(suffix)
        self.keep = keep
        self.parts: dict[bytes, bytes] = {}
        if self.splits:
            # the same model, held once, for lower-case parts with a space between
            self.of_parts = Tokenizer(self.library.model)
            own = self.library.pre_tokenizer
            self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit() if p["type"] == "Split" else own[i] for i, p in enumerate(parts)])
            vocabulary = content["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, fresh: list[bytes]) -> None:
        """Keep the ids of parts, given in UTF-16; a part's last id, and no other, is of a token that ends a part."""
        for at in range(0, len(fresh), 512):
            block = fresh[at : at + 512]
            ids = np.asarray(self.of_parts.encode_batch_fast([b" \0".join(block).decode("utf-16-le")], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.append(0, np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(cuts) != len(block) + 1:
                self.parts |= {p: self.whole(p.decode("utf-16-le")) for p in block}
                continue
            packed = ids.tobytes()
            self.parts |= {p: packed[i:j] for p, i, j in zip(block, cuts, cuts[1:])}

    def _firsts(self, code: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Whether a part begins at each of these lower-case characters, of which the last three are whitespace.

        Each digit is a part, and so is 's and the like, where the apostrophe stands alone.
        """
        first = (kind != np.append(SPACE, kind[:-1])) & (kind != SPACE) | (kind == NUMBER)
        quote = np.flatnonzero(code[:-3] == ord("'"))
        quote = quote[first[quote] & (kind[quote + 1] == LETTER)]
        one, two = code[quote + 1], code[quote + 2]
        size = np.where(np.isin(one, [*map(ord, "stmd")]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        quote, size = quote[size > 0], size[size > 0]
        first[quote + 1] = False
        first[quote + size] |= kind[quote + size] == LETTER
        return first

    def _cut(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The parts of all texts, in UTF-16, and where each text's end."""
        code = np.frombuffer(("\n".join(texts) + "\n\n\n").lower().encode("utf-16-le"), "<u2")
        kind = self.KINDS[code]
        first = self._firsts(code, kind)
        ends = np.searchsorted(np.flatnonzero(first), np.cumsum([len(t) + 1 for t in texts]))
        solid = kind != SPACE
        places = np.append(2 * np.flatnonzero(first[solid]), 2 * np.count_nonzero(solid))
        parts = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(code[solid])])
        return parts.dictionary_encode(), ends

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        parts, ends = self._cut(texts)
        distinct, known = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), self.parts
        packed = list(map(known.get, distinct))
        if None in packed:
            fresh = [p for p, x in zip(distinct, packed) if x is None]
            if len(known) + len(fresh) > self.keep:
                known.clear()
                fresh = distinct
            self._learn(fresh)
            packed = list(map(known.__getitem__, distinct))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4")))
        found = lists.take(parts.indices)
        ids, cuts = np.asarray(found.values), np.asarray(found.offsets)[np.append(0, ends)].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [self.splits and bool(self.PLAIN.fullmatch(t)) and not self.added.search(t) for t in texts]
        ids = iter(self._plain_ids([t for t, p in zip(texts, plain) if p]) if any(plain) else ())
        return [next(ids) if p else self.whole(t) for t, p in zip(texts, plain)]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(docs: DataFrame, tokenizer: str, out_dir: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write (doc_id, file, start_in_file, n_tokens, ids), in ascending id order, end_id closing each document."""
    ready(docs.sparkSession)
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, at, file = word_encoder(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            block = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)), dtype=np.int64) // BLOCK_BYTES
            cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(batch)).tolist()
            for i, j in zip(cuts, cuts[1:]):
                part = batch.slice(i, j - i)
                packed = [x + end for x in encoder.encode([x or "" for x in part.column(1).to_pylist()])]
                sizes = np.array([len(x) // 4 for x in packed], np.int64)
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(part), file, np.int32)), pa.array(at + ends - sizes), pa.array(sizes), ids], ["doc_id", "file", "start_in_file", "n_tokens", "ids"])
                at += int(ends[-1]) if len(ends) else 0

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("tie"))
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    (
        ranged.mapInArrow(run, f"doc_id {kind}, file int, start_in_file long, n_tokens long, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "5000")
        .option("orc.stripe.size", str(64 << 20))
        .orc(out_dir)
    )


def read(spark: SparkSession, out_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files; start counts the ids of all documents before."""
    rows = spark.read.orc(out_dir)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each file
    before, offsets = 0, []
    for file, n in sorted(totals):
        offsets.append((file, before))
        before += n
    places = spark.createDataFrame(offsets, "file int, before long")
    return rows.join(F.broadcast(places), "file").select(
        "doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids"
    )


def lookup(spark: SparkSession, out_dir: str, ids: list[int]) -> DataFrame:
    """The rows of the files with one of these ids; the condition reaches the ORC reader."""
    return spark.read.orc(out_dir).where(F.col("doc_id").isin(ids))


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat = np.asarray(ids.values).astype("<u4")
            cuts = np.asarray(ids.offsets)
            crcs = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def written_digests(docs: DataFrame, tokenizer: str, end_id: int = 1, scratch: Scratch | None = None, **columns) -> DataFrame:
    """Write the files to scratch, read them back, digest what was read."""
    spark = docs.sparkSession
    out_dir = (scratch or Scratch(spark, "token-files")).path("orc")
    write(docs, tokenizer, out_dir, end_id, **columns)
    return digests(read(spark, out_dir))
