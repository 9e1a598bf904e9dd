"""Conversation structure repair by composition of weighted finite-state machines.

Three machines are composed: an acceptor of a conversation's rows as they are, a
transducer of edits (Keep 0, Rerole to user or assistant 2, Delete 3, Insert an
empty user or assistant turn 2; a row that is kept or reroled though cut off
costs 1 more), and an acceptor of legal role orders, `(s?(ua)+)?`.  A composed
state is a place between rows and a state of the grammar.  Its arcs are made
when they are asked for, from the row's class alone (role initial, fault), so
only a few dozen are ever made.  Weights are (cost, labels) in lexicographic
order.  As putting a label in front keeps the order of two label strings, and
adding one at the end doesn't, paths are relaxed from the last row backwards, in
topological order; the machine's only cycles are insertions, and at most two in
a row can be cheapest.  The order of label strings is held as ranks of the four
grammar states, so a row costs constant time however long the conversation.  For
each state a label leads to one state only, so the labels name the repair.

Rows of a conversation are ordered by turn, nulls first, then role and a hash of
the text; null conversations are one conversation, and null roles and texts
count as one space.  A row's first fault counts: blank, duplicate (an earlier row
has its role and text), truncated (it doesn't end in a full stop, exclamation or
question mark).  Blank and duplicate rows must go.

Equal rows and the first turn of each (conversation, role, hash of the text) are
summed up before they are shuffled, so a text that a third of all rows hold
costs a row for each task.  Texts stay where they are meanwhile: a first pass
sorts turns and classes alone and gives each conversation's labels, a byte for each
row, as the audit column has to hold; a second pass sorts the texts behind
their labels and lets them stream by.  No conversation's texts are ever held
together, however long it is.

Empty texts are blank.  Very long texts are rows like others.  Repeated rows are
duplicates.  Extra columns are left out, whatever their names.  An empty table
gives no rows; a conversation whose rows are all gone gives zeros, no labels and
the hash of nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidelog.llm.common import ready

#: The grammar: state -> {role initial: next state}; 0 nothing yet, 1 after the system, 2 after a user, 3 after an assistant.
GRAMMAR: dict[int, dict[str, int]] = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
#: The edit transducer's weights, and what a cut-off row costs where it stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Roles that reroled and inserted turns can have, by initial.
ROLES = {"u": "user", "a": "assistant"}
#: Faults of a row: none, blank, duplicate, truncated.
FINE, BLANK, DUPLICATE, CUT_OFF = 0, 1, 2, 3
#: A class is 4 * the place of the initial in "sua" (3: any other) + the fault.
INITIALS = "sua"
MOST = 1 << 60


@cache
def arcs(state: int, kind: int) -> tuple[tuple[int, str, int], ...]:
    """(cost, label, next state) of the composed arcs that read a row of class `kind` in a grammar state, by label."""
    initial, fault = (INITIALS + "-")[kind // 4], kind % 4
    out = [(DELETE, "D", state)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT_OFF else 0
        out += [(KEEP + more, "K", GRAMMAR[state][initial])] if initial in GRAMMAR[state] else []
        out += [(REROLE + more, "R", GRAMMAR[state][r]) for r in ROLES if r in GRAMMAR[state]]
    return tuple(out)


@cache
def insertion(state: int) -> int:
    """The state after an inserted turn."""
    return next(GRAMMAR[state][r] for r in ROLES if r in GRAMMAR[state])


def _ranked(keys: list[tuple]) -> list[int]:
    """The place of each key among the different ones."""
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    return [place[k] for k in keys]


def repair(kinds: Iterable[int]) -> tuple[int, str]:
    """The least cost, and of the label strings of that cost the least, for rows of these classes."""
    kinds, states = np.asarray(kinds, np.uint8), tuple(GRAMMAR)
    chosen = np.zeros((len(kinds) + 1, len(states)), np.uint8)  # label of the best arc at each place and state, 0 at an end

    def with_insertions(cost: list[int], keys: list[tuple], labels: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Best costs, ranks and labels at one place, given those of paths that don't insert there first."""
        best = [(c, k) for c, k in zip(cost, keys)]
        for _ in range(2):  # two insertions in a row at most
            known = list(best)
            for q in states:
                c, k = known[insertion(q)]
                if c < MOST and (c + INSERT, (ord("I"), *k)) < best[q]:
                    best[q], labels[q] = (c + INSERT, (ord("I"), *k)), ord("I")
        return [c for c, _ in best], _ranked([k for _, k in best]), labels

    cost, rank, chosen[-1] = with_insertions([0 if q in FINAL else MOST for q in states], [()] * len(states), [0] * len(states))
    memo: dict[tuple, tuple] = {}
    for i in range(len(kinds) - 1, -1, -1):
        low = min(cost)
        seen = (int(kinds[i]), *(c - low for c in cost), *rank)  # costs count from the least, so few cases differ
        if seen not in memo:
            new, keys, labels = [], [], []
            for q in states:
                options = [(w + cost[to] - low, (ord(label), rank[to]), ord(label)) for w, label, to in arcs(q, int(kinds[i])) if cost[to] < MOST]
                c, k, label = min(options, default=(MOST, (), 0))
                new.append(c)
                keys.append(k)
                labels.append(label)
            memo[seen] = with_insertions(new, keys, labels)
        step, rank, chosen[i] = memo[seen]
        cost = [min(c + low, MOST) for c in step]
    state, i, out = 0, 0, bytearray()
    while label := int(chosen[i, state]):
        out.append(label)
        if label == ord("I"):
            state = insertion(state)
        else:
            state = next(to for _, name, to in arcs(state, int(kinds[i])) if ord(name) == label)
            i += 1
    return cost[0], out.decode()


#: Space, tab, newline, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
#: The order of a conversation's rows; a null turn comes first.
PLACE = ("turn", "role", "hash")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = np.zeros((4, 4), bool)  # by initials: su, ua, au
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def as_they_are(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, times): times is how often a row stands there."""
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), _named(role_col).alias("role"), _named(text_col).alias("text"), F.lit(1).cast("long").alias("times"))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of as_they_are() damaged as crc32 of `conv:turn` decides: dropped, emptied, cut off, repeated or given to the user; a dropped row stays with times 0."""
    kind = F.crc32(F.concat(_named(conv_col), F.lit(":"), _named(turn_col)).cast("binary")) % 20
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), _named(role_col).alias("role"), _named(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long")
    return plain.select("conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))


def _hash(column: str) -> Column:
    return F.unhex(F.sha2(column, 256))


def classed(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, hash, times, kind, further): the classes of equal rows' first copy and of further ones, without texts."""
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(CUT_OFF)
    slim = rows.where("times > 0").select("conv", "turn", "role", _hash("text").alias("hash"), fault.alias("own"), "times")
    equal = slim.groupBy("conv", *PLACE, "own").agg(F.sum("times").alias("times"))
    # A struct of a null turn is the least, as in the order of rows.
    first = equal.where(F.col("own") != BLANK).groupBy("conv", "role", "hash").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    first = first.select(F.col("conv").alias("__conv"), F.col("role").alias("__role"), F.col("hash").alias("__hash"), "first")
    same = F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("hash") == F.col("__hash"))
    both = equal.join(first, same, "left")
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3) * 4
    later = F.when(F.col("own") == BLANK, BLANK).otherwise(DUPLICATE)
    here = F.when(F.col("first").isNull() | F.col("first")["turn"].eqNullSafe(F.col("turn")), F.col("own")).otherwise(later)
    return both.select("conv", *PLACE, "times", (initial + here).cast("byte").alias("kind"), (initial + later).cast("byte").alias("further"))


def _schema(rows: DataFrame, *more: StructField) -> StructType:
    return StructType([StructField("conv", rows.schema["conv"].dataType), *more])


def summaries(rows: DataFrame) -> DataFrame:
    """conv, the counts and audit of each conversation that has rows.  rows: those of as_they_are() or damaged()."""
    schema = _schema(rows, *[StructField(c, LongType()) for c in COUNTS], StructField("audit", StringType()))
    arrow, names = to_arrow_schema(schema), schema.names

    def one(conv, turns: list[np.ndarray], kinds: list[np.ndarray]) -> dict:
        turn, kind = np.concatenate(turns), np.concatenate(kinds)
        initial, fault = kind >> 2, kind & 3
        gaps = int(turn[-1]) - int(turn[0]) - int((turn[1:] != turn[:-1]).sum()) if len(turn) else 0
        cost, audit = repair(kind)
        counts = [int((fault == f).sum()) for f in (BLANK, DUPLICATE, CUT_OFF)]
        return dict(zip(names, (conv, gaps, *counts, int((~_LEGAL[initial[:-1], initial[1:]]).sum()), cost, audit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, kinds, out = None, [], [], []
        for batch in batches:
            ids, (turn, times, kind, further) = batch.column(0), batch.columns[1:]
            code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cut = np.concatenate([[0], np.nonzero(np.diff(code))[0] + 1, [len(code)]]) if len(code) else np.zeros(1, np.int64)
            times, kind, further = (a.to_numpy() for a in (times, kind, further))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                own = ids[i].as_py()
                if kinds and own != conv:
                    out.append(one(conv, turns, kinds))
                    turns, kinds = [], []
                conv = own
                each = np.repeat(further[i:j], times[i:j])
                each[np.cumsum(times[i:j]) - times[i:j]] = kind[i:j]
                kinds.append(each)
                turns.append(np.asarray(turn[i:j].drop_null(), np.int64))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if kinds:
            out.append(one(conv, turns, kinds))
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    ready(rows.sparkSession)
    ordered = classed(rows).repartition("conv").sortWithinPartitions("conv", *PLACE)
    return ordered.select("conv", "turn", "times", "kind", "further").mapInArrow(run, schema)


class Replay:
    """One conversation's repair, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _new(self) -> str:
        initial = next(r for r in ROLES if r in GRAMMAR[self.state])
        self.state = GRAMMAR[self.state][initial]
        return ROLES[initial]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(label, role, text) of the turns inserted at this place."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._new(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(label, role, text) of the turns inserted before a row, and of the row unless it goes."""
        yield from self.inserted()
        label, self.at = self.audit[self.at], self.at + 1
        if label == "R":
            yield label, self._new(), text
        elif label == "K":
            self.state = GRAMMAR[self.state][role[0]]
            yield label, role, text


def _behind_labels(rows: DataFrame) -> DataFrame:
    """(conv, what, *COUNTS, role, text, times): for each conversation a row of what 0, its summary as 1 with the audit as text, then its rows in order."""
    def part(of: DataFrame, what: int, **known) -> DataFrame:
        plain = {"turn": "long", "role": "string", "hash": "binary", "text": "string", "times": "long"} | dict.fromkeys(COUNTS, "long")
        return of.select("conv", F.lit(what).alias("what"), *[known.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in plain.items()])

    there = part(rows.groupBy("conv").agg(F.count("*")), 0)
    known = part(summaries(rows), 1, text=F.col("audit"), **{c: F.col(c) for c in COUNTS})
    texts = part(rows.where("times > 0"), 2, hash=_hash("text"), **{c: F.col(c) for c in ("turn", "role", "text", "times")})
    both = there.unionByName(known).unionByName(texts)
    return both.repartition("conv").sortWithinPartitions("conv", "what", *PLACE).select("conv", "what", *COUNTS, "role", "text", "times")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, counts, audit, what became of the rows) of each conversation; the last must be used up before the next is asked for."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    ahead = next(rows, None)

    def turns(conv, audit: str) -> Iterator[tuple[str, str, str]]:
        nonlocal ahead
        replay = Replay(audit)
        while ahead and ahead[1] == 2 and ahead[0] == conv:
            for _ in range(ahead[-1]):
                yield from replay.row(*ahead[-3:-1])
            ahead = next(rows, None)
        yield from replay.inserted()

    while ahead:
        conv, counts, audit = ahead[0], [0] * len(COUNTS), ""
        ahead = next(rows, None)
        if ahead and ahead[1] == 1:
            counts, audit = ahead[2 : 2 + len(COUNTS)], ahead[-2]
            ahead = next(rows, None)
        yield conv, counts, audit, turns(conv, audit)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the repaired conversations, turn by turn from place 0; edit is the label of what made a turn.  rows: those of as_they_are() or damaged()."""
    schema = _schema(rows, StructField("place", LongType()), *[StructField(c, StringType()) for c in ("edit", "role", "text")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, load = [], 0
        for conv, _, _, turns in _conversations(batches):
            for place, (label, role, text) in enumerate(turns):
                out.append({"conv": conv, "place": place, "edit": label, "role": role, "text": text})
                load += len(text) + 50
                if load > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, load = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _behind_labels(rows).mapInArrow(run, schema)


def digests(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of the repaired `role:text`, joined by newlines).  rows: those of as_they_are() or damaged()."""
    schema = _schema(rows, *[StructField(c, LongType()) for c in COUNTS], StructField("audit", StringType()), StructField("repaired_sha256", StringType()))
    arrow, names = to_arrow_schema(schema), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, counts, audit, turns in _conversations(batches):
            sha, joint = hashlib.sha256(), b""
            for _, role, text in turns:
                sha.update(joint + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                joint = b"\n"
            out.append(dict(zip(names, (conv, *counts, audit, sha.hexdigest()))))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _behind_labels(rows).mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def digests_sql() -> str:
    """digests() of the damaged rows in DuckDB SQL: costs and labels row by row from the last, then turns label by label from the first."""
    weight = lambda cost, label, of: f"struct_pack(c := {of}.c + {cost}, k := '{label}' || {of}.k)"

    def consumed(state: int) -> str:
        cut, stays = f"CASE WHEN fault = {CUT_OFF} THEN {TRUNCATED} ELSE 0 END", f"fault NOT IN ({BLANK}, {DUPLICATE})"
        ways = [weight(DELETE, "D", f"v{state}")]
        for initial, to in GRAMMAR[state].items():
            ways.append(f"CASE WHEN {stays} AND role[1] = '{initial}' THEN {weight(f'{KEEP} + {cut}', 'K', f'v{to}')} END")
            if initial in ROLES:
                ways.append(f"CASE WHEN {stays} THEN {weight(f'{REROLE} + {cut}', 'R', f'v{to}')} END")
        return f"least({', '.join(ways)}) AS w{state}"

    inserted = [f"least(w{q}, {weight(INSERT, 'I', f'w{insertion(q)}')}) AS u{q}" for q in GRAMMAR]
    twice = [f"least(u{q}, {weight(INSERT, 'I', f'u{insertion(q)}')}) AS v{q}" for q in GRAMMAR]
    end = lambda c, k: f"struct_pack(c := {c}::BIGINT, k := '{k}')"
    return rf"""
    WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_reduce(
            list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
            lambda c, b: list_reduce([1::BIGINT, 2, 3, 4, 5, 6, 7, 8], lambda s, n: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(c, b)), 4294967295::BIGINT) AS c FROM conversations),
    drawn AS (SELECT conv_id, turn, role, text, xor(c, 4294967295) % 20 AS kind FROM named),
    damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM drawn WHERE kind <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged),
    rows_ AS (SELECT conv_id, turn, role, text, i, CASE WHEN last = '' THEN {BLANK} WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN {DUPLICATE}
        WHEN last IN ('.', '!', '?') THEN {FINE} ELSE {CUT_OFF} END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate,
        count(*) FILTER (fault = {CUT_OFF}) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rows_ GROUP BY conv_id),
    paths(conv_id, i, v0, v1, v2, v3) AS (SELECT conv_id, n + 1, {end(0, '')}, {end(2 * INSERT, 'II')}, {end(INSERT, 'I')}, {end(0, '')} FROM counts UNION ALL
        SELECT conv_id, i, {", ".join(twice)} FROM (SELECT conv_id, i, {", ".join(inserted)} FROM (
            SELECT r.conv_id, r.i, {", ".join(map(consumed, GRAMMAR))} FROM paths p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i - 1))),
    best AS (SELECT conv_id, v0.c AS cost, v0.k AS audit FROM paths WHERE i = 1),
    walk(conv_id, audit, p, i, last, role, text) AS (SELECT conv_id, audit, 0, 0::BIGINT, '', NULL::VARCHAR, NULL::VARCHAR FROM best UNION ALL
        SELECT conv_id, audit, p, i, CASE WHEN role IS NULL THEN last ELSE role[1] END, role, text FROM (
            SELECT w.conv_id, w.audit, w.p + 1 AS p, CASE WHEN audit[w.p + 1] = 'I' THEN w.i ELSE w.i + 1 END AS i, w.last,
                CASE audit[w.p + 1] WHEN 'D' THEN NULL WHEN 'K' THEN r.role ELSE CASE WHEN w.last = 'u' THEN 'assistant' ELSE 'user' END END AS role,
                CASE audit[w.p + 1] WHEN 'I' THEN '' ELSE r.text END AS text
            FROM walk w LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 WHERE w.p < length(w.audit))),
    said AS (SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY p)) AS repaired_sha256 FROM walk WHERE role IS NOT NULL GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
        coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM o.conv_id
    """
