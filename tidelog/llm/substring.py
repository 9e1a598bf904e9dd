"""Substring deduplication over prefix-partitioned suffix trees.

A suffix begins at every word of every document.  Prefixes of variable length deal
the suffixes into groups that fit in memory: a first pass counts suffixes by
hash cells of their first 2 and of their first 4 words; small cells are put
together, and a cell too large for a group is split by bits of a hash of the
whole window.  A group's suffixes are then sorted by the hash of their first
`window` words, not by the words themselves: a run of equal hashes stands for the
internal node at depth `window` that these suffixes share in the suffix tree, and
the run's smallest document owns it.  The tree's other nodes aren't built: above
that depth nothing is removed, and longer repeats are runs of windows.

Suffixes travel in packets.  Documents are taken in batches of bounded size; a
batch sends at most FAN packets, one for each group.  Where there are more than
FAN groups, a packet goes to a range of FAN, FAN ** 2 ... groups first; packets
of one range are put together to a batch's size and dealt again.  Answers go
to buckets of documents, each of about a batch's size, in the same way: a group sends at
most FAN packets.  So the number of packets grows as the input, not as batches
times groups or documents times groups.  A bucket gives one row for each
document that loses something, which is joined to the documents.

Paths are compared by 64-bit hashes of their words, so that a suffix travels in
about 10 bytes; the words aren't compared afterwards.  Among n different windows
some n ** 2 / 2 ** 65 pairs agree by chance, of which the later loses its words
wrongly: 0.7 of them in 30 GB of text, some 8 million in 100 TB.  Within a batch of documents a path is sent once, by its smallest
document, and the batch's other occurrences are answered where they are, so a
passage that a third of all documents share sends one suffix a batch.

Every word covered by a window that also starts in a document with a smaller id
is removed; windows are judged on the input.  Null and empty texts have no
words.  Rows with a null id own nothing and lose nothing.  Rows with equal ids
don't take from each other; ids with several texts are listed first, and their
rows told apart by a hash of the text.  A very long text is a batch of its own.
Extra columns, of whatever names, are kept by `deduplicated`.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, ready, sized
from tidelog.llm.words import hashes_of, mix, runs, words_of

#: Words of a batch; suffixes of a group at most, and at least where there are few; packets of a batch.
BATCH, GROUP, LEAST, FAN = 1_000_000, 9_000_000, 16_384, 2048
#: Cells of the first 2 words, and of the first 4 within them.
LEVELS = (64, 64)
#: What a packet holds of each suffix, and of each answer.  Marks tell rows apart that share an id, else they are 0.
SUFFIX = (("path", "<u8"), ("id", "<i8"), ("mark", "<u8"), ("place", "<u4"), ("group", "<u4"))
ANSWER = (("doc", "<i8"), ("mark", "<u8"), ("first", "<u4"))
_RUNNING = ("path", "doc", "first")  # sent as differences, wrapping round


def _pack(columns: tuple, arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length as bytes, the bytes of equal weight together, compressed."""
    planes = []
    for (name, kind), a in zip(columns, arrays):
        a = np.diff(a, prepend=a.dtype.type(0)) if name in _RUNNING else a
        planes.append(np.ascontiguousarray(a.astype(kind, copy=False).view(np.uint8).reshape(len(a), np.dtype(kind).itemsize).T).tobytes())
    return struct.pack("<I", len(arrays[0])) + zstandard.compress(b"".join(planes), 1)


def _unpack(columns: tuple, data) -> list[np.ndarray]:
    data = memoryview(data)
    (n,) = struct.unpack_from("<I", data)
    planes, at, out = np.frombuffer(zstandard.decompress(data[4:]), np.uint8), 0, []
    for name, kind in columns:
        width = np.dtype(kind).itemsize
        a = np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(kind).reshape(n)
        out.append(np.cumsum(a, dtype=a.dtype) if name in _RUNNING else a)
        at += n * width
    return out


def _together(columns: tuple, bodies: list) -> list[np.ndarray]:
    return [np.concatenate(a) for a in zip(*(_unpack(columns, b) for b in bodies))]


def _cells(h: np.ndarray, n: int) -> np.ndarray:
    """The prefix cells of the first n windows of one document's word hashes; windows of under 4 words have one prefix."""
    one, two = runs(h, 2)[:n], runs(h, 4)[:n]
    two = two if len(two) == n else np.zeros(n, np.uint64)
    one = one if len(one) == n else np.zeros(n, np.uint64)
    return (one % np.uint64(LEVELS[0]) * np.uint64(LEVELS[1]) + two % np.uint64(LEVELS[1])).astype(np.int32)


def prefix_groups(counts: np.ndarray, fan: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first group and the number of groups of each cell: neighbouring cells share one, a large cell has several."""
    fan = fan or FAN
    tree = counts.reshape(LEVELS)
    budget = min(max(int(counts.sum()) * 9 // (4 * fan), LEAST), GROUP)  # groups are half full at least, so they number up to fan
    group, out, parts, load = 0, np.zeros(LEVELS, np.int64), np.ones(LEVELS, np.int64), 0

    def put(index, total: int) -> None:
        nonlocal group, load
        if load and load + total > budget:
            group, load = group + 1, 0
        out[index], parts[index] = group, max(1, -(-total // budget))
        group, load = group + int(np.max(parts[index])) - 1, load + total

    for a in range(LEVELS[0]):
        total = int(tree[a].sum())
        if total <= budget:
            put(a, total)
            continue
        for b in range(LEVELS[1]):
            put((a, b), int(tree[a, b]))
    return out.reshape(-1), parts.reshape(-1)


def _steps(n: int) -> list[int]:
    """Widths of the key ranges that packets for n keys go through, down to 1."""
    width, out = 1, [1]
    while width * FAN < n:
        width *= FAN
        out.insert(0, width)
    return out


def _bucket(ids: np.ndarray, marks: np.ndarray, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(ids.view(np.uint64) ^ marks) % np.uint64(width)).astype(np.int64)


def suffix_counts(rows: DataFrame, window: int) -> np.ndarray:
    """How many windows each cell has.  rows: (id, mark, text)."""
    n_cells = LEVELS[0] * LEVELS[1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_cells, np.int64)
        for part in parts:
            for x in part.column(2):
                h = hashes_of(words_of(x.as_py()))
                if len(h) >= window:
                    total += np.bincount(_cells(h, len(h) - window + 1), minlength=n_cells)
        cell = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])

    out = np.zeros(n_cells, np.int64)
    for cell, n in rows.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row for each cell
        out[cell] = n
    return out


def _packets(key: np.ndarray, columns: tuple, arrays: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(key, body) for each of the keys, which are in order."""
    cuts = np.append(np.nonzero(np.append(True, key[1:] != key[:-1]))[0], len(key)) if len(key) else [0]
    for i, j in zip(cuts, cuts[1:]):
        yield int(key[i]), _pack(columns, [a[i:j] for a in arrays])


def _out(keys: list[int], answered: list[bool], bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(answered, pa.bool_()), pa.array(bodies, pa.binary())], ["key", "answered", "body"])


PACKET = "key long, answered boolean, body binary"


def suffixes(rows: DataFrame, window: int, first: np.ndarray, parts: np.ndarray, width: int) -> DataFrame:
    """Packets of suffixes for each range of `width` groups, and one of the answers found within a batch, for any group."""
    groups = int(first[-1] + parts[-1])

    def packets(ids: list, marks: list, hashed: list) -> pa.RecordBatch | None:
        ids, marks = np.array(ids, np.int64), np.array(marks, np.int64).view(np.uint64)
        order = np.argsort(ids, kind="stable")  # places by ascending id, so the smallest owner comes first
        ids, marks, hashed = ids[order], marks[order], [hashed[i] for i in order]
        paths = [runs(h, window) for h in hashed]
        sizes = np.array([len(p) for p in paths])
        path = np.concatenate(paths)
        if not len(path):
            return None
        cell = np.concatenate([_cells(h, len(p)) for h, p in zip(hashed, paths)])
        del paths, hashed
        order = np.argsort(path, kind="stable")
        path, doc, cell = path[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order], cell[order]
        place = (order - (np.cumsum(sizes) - sizes)[doc]).astype(np.uint32)
        del order
        head = np.append(True, path[1:] != path[:-1])
        known = ids[doc] > ids[doc[np.maximum.accumulate(np.where(head, np.arange(len(path), dtype=np.int32), 0))]]
        lost = [ids[doc[known]], marks[doc[known]], place[known]]
        send = ~known  # equal ids with equal windows all go, each needs its own answer
        path, doc, place, cell = path[send], doc[send], place[send], cell[send]
        group = (first[cell] + ((path >> np.uint64(20)) % parts[cell].astype(np.uint64)).astype(np.int64)).astype(np.uint32)
        by = np.argsort(group, kind="stable")
        group, doc = group[by], doc[by]
        made = list(_packets((group // width).astype(np.int64), SUFFIX, [path[by], ids[doc], marks[doc], place[by], group]))
        keys, bodies, n = [k for k, _ in made], [b for _, b in made], len(made)
        if len(lost[0]):
            order = np.lexsort(lost[::-1])
            bodies.append(_pack(ANSWER, [a[order] for a in lost]))
            keys.append(_any(bodies[-1], groups, width))
        return _out(keys, [False] * n + [True] * (len(keys) - n), bodies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, hashed, load = [], [], [], 0
        for part in batches:
            for i, m, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                ids.append(i)
                marks.append(m)
                hashed.append(hashes_of(words_of(x.as_py())))
                load += len(hashed[-1])
                if load >= BATCH:
                    if out := packets(ids, marks, hashed):
                        yield out
                    ids, marks, hashed, load = [], [], [], 0
        if ids and (out := packets(ids, marks, hashed)):
            yield out

    return rows.mapInArrow(run, PACKET)


def _any(body: bytes, groups: int, width: int) -> int:
    return zlib.crc32(body) % groups // width


def _answers(ids: np.ndarray, marks: np.ndarray, first: np.ndarray, bucket: int) -> list[tuple[int, bytes]]:
    """Packets of answers, one for each bucket."""
    to = _bucket(ids, marks, bucket)
    order = np.lexsort((first, marks, ids, to))
    return list(_packets(to[order], ANSWER, [a[order] for a in (ids, marks, first)]))


def dealt(packets: DataFrame, columns: tuple, tasks: int, key_of: Callable[[list[np.ndarray]], np.ndarray], pass_on: Callable[[bytes], int] | None = None) -> DataFrame:
    """Packets of one key put together to a batch's size, and dealt again by key_of; a key is dealt in so many tasks.

    Answers among suffixes go on as they are, to the key of pass_on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bodies, load = None, [], 0

        def again() -> pa.RecordBatch:
            arrays = _together(columns, bodies)
            to = key_of(arrays)
            order = np.lexsort((arrays[0], to) if columns is SUFFIX else (*arrays[::-1], to))
            made = list(_packets(to[order], columns, [a[order] for a in arrays]))
            return _out([k for k, _ in made], [columns is ANSWER] * len(made), [b for _, b in made])

        for batch in batches:
            for k, answered, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if answered and pass_on:
                    yield _out([pass_on(x.as_py())], [True], [x.as_py()])
                    continue
                if bodies and (k != key or load >= BATCH):
                    yield again()
                    bodies, load = [], 0
                key, load = k, load + struct.unpack_from("<I", x.as_buffer())[0]
                bodies.append(x.as_buffer())
        if bodies:
            yield again()

    spread = packets.withColumn("salt", F.pmod(F.xxhash64("body"), F.lit(tasks)))
    return spread.repartition("key", "salt").sortWithinPartitions("key").select("key", "answered", "body").mapInArrow(run, PACKET)


def _subtree(bucket: int):
    """One group: sort its suffixes, and answer those in runs that a smaller document owns."""

    def run(table: pa.Table) -> pa.Table:
        done = table.column("answered")
        packets = [x.as_buffer() for x in table.column("body").filter(pc.invert(done))]
        out = [p for x in table.column("body").filter(done) for p in _answers(*_unpack(ANSWER, x.as_buffer()), bucket)]
        out += owned(packets)
        return pa.Table.from_batches([_out([k for k, _ in out], [True] * len(out), [b for _, b in out])])

    def owned(packets: list) -> list[tuple[int, bytes]]:
        if not packets:
            return []
        paths = [_unpack(SUFFIX, b)[0] for b in packets]
        starts = np.cumsum([0, *map(len, paths)])
        path = np.concatenate(paths)
        del paths
        order = np.argsort(path)
        path = path[order]
        same = path[1:] == path[:-1]
        repeated = np.zeros(len(path), bool)
        repeated[order[np.append(same, False) | np.append(False, same)]] = True
        del path, order, same
        if not repeated.any():
            return []
        own = [repeated[i:j] for i, j in zip(starts, starts[1:])]
        found = [np.concatenate(a) for a in zip(*([a[keep] for a in _unpack(SUFFIX, b)] for b, keep in zip(packets, own) if keep.any()))]
        order = np.argsort(found[0])
        path, ids, mark, place, _ = (a[order] for a in found)
        heads = np.nonzero(np.append(True, path[1:] != path[:-1]))[0]
        lost = ids > np.repeat(np.minimum.reduceat(ids, heads), np.diff(np.append(heads, len(ids))))
        return _answers(ids[lost], mark[lost], place[lost], bucket)

    return run


def _by_document(table: pa.Table) -> pa.Table:
    """One bucket: (id, mark, spans) for each document with answers."""
    ids, marks, first = _together(ANSWER, [x.as_buffer() for x in table.column("body")])
    order = np.lexsort((first, marks, ids))
    ids, marks, first = ids[order], marks[order], first[order]
    heads = np.nonzero(np.append(True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])))[0]
    spans = [_spans(x) for x in np.split(first, heads[1:])]
    return pa.table([pa.array(ids[heads]), pa.array(marks[heads].view(np.int64)), pa.array(spans, pa.binary())], ["id", "mark", "spans"])


def _spans(first: np.ndarray) -> bytes:
    """Sorted first words of windows as little-endian (first, last) pairs of their runs; one window can be answered twice."""
    cut = np.nonzero(np.diff(first.astype(np.int64)) > 1)[0]
    return np.stack([first[np.append(0, cut + 1)], first[np.append(cut, len(first) - 1)]], axis=1).astype("<u4").tobytes()


def repeats(rows: DataFrame, window: int) -> DataFrame:
    """(id, mark, spans): the windows of each document that start in a smaller one too, as runs of first words."""
    counts = suffix_counts(rows, window)
    total, (first, parts) = int(counts.sum()), prefix_groups(counts)
    groups = int(first[-1] + parts[-1])
    steps, back = _steps(groups), _steps(max(1, total // BATCH))
    buckets = -(-max(1, total // BATCH) // back[0]) * back[0]  # so that each step's ranges are parts of those before
    widths = [FAN**n for n in range(1, len(back))] + [buckets]
    tasks = lambda keys: max(1, total // (keys * BATCH * 16))
    packets = suffixes(rows, window, first, parts, steps[0])
    for n, width in enumerate(steps[1:], 1):
        packets = dealt(packets, SUFFIX, tasks(FAN**n), lambda a, w=width: a[4].astype(np.int64) // w, lambda body, w=width: _any(body, groups, w))
    found = packets.groupBy("key").applyInArrow(_subtree(widths[0]), PACKET)
    for n, width in enumerate(widths[1:], 1):
        found = dealt(found, ANSWER, tasks(FAN**n), lambda a, w=width: _bucket(a[0], a[1], w))
    return found.groupBy("key").applyInArrow(_by_document, "id long, mark long, spans binary")


def joined(docs: DataFrame, window: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """The columns of docs as c0, c1 ..., and spans, null for documents that lose nothing."""
    ready(docs.sparkSession)
    names = docs.schema.fieldNames()
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])  # whatever the columns are called, they clash with none here
    i, t = F.col(f"c{names.index(id_col)}").cast("long"), F.col(f"c{names.index(text_col)}").cast("string")
    named = rows.withColumns({"id": i, "text": t, "hash": F.xxhash64(t)})
    several = named.where("id is not null").groupBy("id").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("lo <> hi").select("id")
    several = scratch.table(several, "several")
    n = several.count()
    several = sized(several.withColumn("again", F.lit(True)), n)

    def marked(df: DataFrame) -> DataFrame:
        return df.join(several, "id", "left").withColumn("mark", F.when(F.col("again"), F.col("hash")).otherwise(F.lit(0).cast("long"))) if n else df.withColumn("mark", F.lit(0).cast("long"))

    found = scratch.table(repeats(marked(named.where("id is not null and text is not null")).select("id", "mark", "text"), window), "repeats")
    return marked(named).drop("hash", "again", "text").join(found.hint("merge"), ["id", "mark"], "left").drop("id", "mark")


def covered(spans: bytes, window: int, n_words: int) -> np.ndarray:
    """Which of a document's words its repeated windows cover."""
    edge = np.zeros(n_words + 1, np.int64)
    first, last = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64).T
    np.add.at(edge, first, 1)
    np.add.at(edge, last + window, -1)
    return np.cumsum(edge)[:n_words] > 0


def digests(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (of the kept words joined by single spaces) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, shas = [], [], []
            for x, spans in zip(batch.column(1), batch.column(2)):
                words = words_of(x.as_py())
                kept = [w for w, c in zip(words, covered(spans.as_py(), window, len(words)).tolist()) if not c] if spans.is_valid else words
                total.append(len(words))
                gone.append(len(words) - len(kept))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())], [id_col, "n_words", "n_removed", "kept_sha256"])

    scratch = scratch or Scratch(docs.sparkSession, "substring")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return joined(rows, window, "id", "text", scratch).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")


def cut(text: str, lost: np.ndarray) -> str:
    """text without the lost words and the blanks after them; the rest as it was."""
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    out, at = [], 0
    for i, (begin, _) in enumerate(spans):
        end = spans[i + 1][0] if i + 1 < len(spans) else len(data)
        if lost[i]:
            out.append(data[at:begin])
            at = end
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def deduplicated(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs with the covered words cut out of the text column; rows without repeats are unchanged."""
    names = docs.schema.fieldNames()
    at = names.index(text_col)

    def one(text: str | None, spans: pa.Scalar) -> str | None:
        return cut(text, covered(spans.as_py(), window, len(words_of(text)))) if text and spans.is_valid else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[: len(names)]
            columns[at] = pa.array([one(x.as_py(), spans) for x, spans in zip(batch.column(at), batch.column(len(names)))], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined(docs, window, id_col, text_col, scratch or Scratch(docs.sparkSession, "substring")).mapInArrow(run, docs.schema)
