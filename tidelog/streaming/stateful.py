"""Operators whose state Spark keeps for each key: repeats of what was kept lately, and intervals that must not overlap.

Rows of a batch are taken in the order of (time, id).  State is bounded: the
last few kept rows, or intervals by the hour within a horizon.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tidelog.sources.tables import workers_import

#: Spark's state store for such operators.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
HOUR = 3_600_000_000


def _kept(ts: int, text: str, kept: list, within: int, remembered: int) -> bool:
    """Whether a row repeats none of the kept ones; if so it is remembered."""
    if any(text == old and ts - at < within for at, old in kept):
        return False
    kept.append((ts, text))
    del kept[:-remembered]
    return True


class _Repeats(StatefulProcessor):
    def __init__(self, text: str, within: int, remembered: int):
        self.text, self.within, self.remembered = text, within, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        kept = [tuple(x) for x in json.loads(self.kept.get()[0])] if self.kept.exists() else []
        batch = pd.concat(list(rows)).sort_values(["ts_us", "id"])
        mask = [_kept(int(ts), (x or "").translate(_ASCII_LOWER), kept, self.within, self.remembered) for ts, x in zip(batch["ts_us"], batch[self.text])]
        self.kept.update((json.dumps(kept),))
        yield batch[mask]

    def close(self) -> None:
        pass


def without_repeats(rows: DataFrame, key: str, text: str, within: int, remembered: int = 8) -> DataFrame:
    """`timeline.collapsed_repeats` for a stream whose batches come in the order of time; the state of a key is `remembered` rows."""
    workers_import(rows.sparkSession)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(key).transformWithStateInPandas(_Repeats(text, within, remembered), outputStructType=rows.schema, outputMode="Append", timeMode="None")


ACCEPTED, REPLAYED, OVERLAPPING, DELETED = "accepted", "replayed", "overlapping", "deleted"


class _Intervals(StatefulProcessor):
    def __init__(self, barriers: list[tuple[int, int]], longest: int):
        self.barriers, self.longest = barriers, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getMapState("hours", "hour long", "intervals string")

    def _near(self, hour: int) -> list:
        return json.loads(self.hours.getValue((hour,))[0]) if self.hours.containsKey((hour,)) else []

    def _outcome(self, start: int, end: int, id_: int) -> str:
        if any(start < b and a < end for a, b in self.barriers):
            return DELETED
        first, last = (start - self.longest) // HOUR, end // HOUR
        met = [x for h in range(first, last + 1) for x in self._near(h) if start < x[1] and x[0] < end]
        if met:
            return REPLAYED if met == [[start, end, id_]] else OVERLAPPING
        own = self._near(start // HOUR)
        self.hours.updateValue((start // HOUR,), (json.dumps([*own, [start, end, id_]]),))
        return ACCEPTED

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["start_us", "end_us", "id"])
        bad = (batch["end_us"] <= batch["start_us"]) | (batch["end_us"] - batch["start_us"] > self.longest)
        outcome = ["invalid" if b else self._outcome(int(s), int(e), int(i)) for b, s, e, i in zip(bad, batch["start_us"], batch["end_us"], batch["id"])]
        yield batch.assign(outcome=outcome)

    def close(self) -> None:
        pass


def appended(intervals: DataFrame, key: str, barriers: list[tuple[int, int]] = (), longest: int = HOUR) -> DataFrame:
    """intervals (key, id, start_us, end_us) with `outcome`: accepted, replayed (all of it known), overlapping, deleted or invalid.

    An interval in a deleted range is dropped whole, even a replay; any other
    overlap with an accepted one is refused; adjacent and earlier ones are fine.
    """
    workers_import(intervals.sparkSession)
    intervals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = intervals.select(key, "id", "start_us", "end_us")
    schema = StructType([*rows.schema.fields, StructField("outcome", StringType())])
    return rows.groupBy(key).transformWithStateInPandas(_Intervals(list(barriers), longest), outputStructType=schema, outputMode="Append", timeMode="None")
