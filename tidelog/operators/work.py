"""What someone worked on: main items, folders, digests, briefs, labels of tagged words, windows of text lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.store import even_sample, latest

#: Words that tell what a line of a digest is about, by section in order.
SIGNALS = (
    ("decisions", ("decided", "decision", "agreed", "approved", "chose")),
    ("open loops", ("todo", "follow up", "blocked", "waiting", "question", "next step")),
    ("shipped", ("merged", "released", "shipped", "deployed", "fixed", "done")),
)


def main_item(rows: DataFrame, session: str, item: str, held: str) -> DataFrame:
    """The item that was held longest in each session; of equals the smaller."""
    total = rows.groupBy(session, item).agg(F.sum(held).alias(held))
    return latest(total, [session], F.desc(held), item)


def main_kind(rows: DataFrame, session: str, kind: str, held: str, declared: list[str]) -> DataFrame:
    """The kind of each session by time, by counts where no time was measured; ties go to the kind declared first."""
    place = F.array_position(F.array(*map(F.lit, declared)), F.col(kind))
    per = rows.groupBy(session, kind).agg(F.sum(held).alias("__us"), F.count("*").alias("__n"))
    order = W.partitionBy(session).orderBy(F.desc("__weight"), place)
    measured = F.sum("__us").over(W.partitionBy(session)) > 0
    weighed = per.withColumn("__weight", F.when(measured, F.col("__us")).otherwise(F.col("__n")))
    return weighed.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(session, kind)


def folder_guess(paths: DataFrame, key: str, path: str, weight: str) -> DataFrame:
    """The folder with the greatest weight for each key; of equals the shorter, then the smaller."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    total = paths.groupBy(key, folder.alias("folder")).agg(F.sum(weight).alias("weight")).where("folder <> ''")
    return latest(total, [key], F.desc("weight"), F.length("folder"), "folder")


def active_days(rows: DataFrame, item: str, day: str, held: str, least: int) -> DataFrame:
    """Per item: time in all, in the last 7 and 14 *active* days, and number of days; items under `least` are left out.

    Active days are those with any row; their ranks come from the distinct days.
    """
    days = rows.select(day).distinct()
    ranked = days.withColumn("__back", F.dense_rank().over(W.orderBy(F.desc(day))))  # one row a day
    timed = rows.join(F.broadcast(ranked), day)
    total = timed.groupBy(item).agg(
        F.sum(held).alias("total"), F.sum(F.when(F.col("__back") <= 14, F.col(held)).otherwise(0)).alias("last_14"),
        F.sum(F.when(F.col("__back") <= 7, F.col(held)).otherwise(0)).alias("last_7"), F.countDistinct(day).alias("days"),
    )
    return total.where(F.col("total") >= least)


def section(line):
    low = F.lower(line)
    out = F.when(F.lit(False), F.lit(""))
    for name, words in SIGNALS:
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("notes"))


def digest(rows: DataFrame, keys: list[str], n: int = 9, id_: str = "id", text: str = "text") -> DataFrame:
    """At most n lines of each key: the best of each section first, then the best of the rest; each cites its moment.

    Lines of 4 to 40 words; repeated lines count once, by the smallest id; a
    line ranks by its section, then by its number of words up to 20, then by id.
    """
    spread = rows.select(*keys, id_, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    spread = spread.withColumns({"line": F.trim("line"), "words": F.size(F.split(F.trim("line"), r"\s+"))}).where(F.col("words").between(4, 40))
    once = latest(spread, [*keys, "line"], id_, "pos").withColumn("section", section(F.col("line")))
    weight = F.when(F.col("section") == "notes", 0).otherwise(1) * 100 + F.least("words", F.lit(20))
    first = F.row_number().over(W.partitionBy(*keys, "section").orderBy(F.desc("weight"), id_, "pos"))
    ranked = once.withColumn("weight", weight).withColumn("__in", first)
    order = W.partitionBy(*keys).orderBy(F.when(F.col("__in") == 1, 0).otherwise(1), F.desc("weight"), id_, "pos")
    out = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return out.select(*keys, "place", "section", id_, F.concat("line", F.lit(" [event:"), F.col(id_).cast("string"), F.lit("]")).alias("line"))


def brief(rows: DataFrame, day: str, most: int = 2048, n: int = 9) -> DataFrame:
    """A digest of each day over an even sample of its moments."""
    return digest(even_sample(rows, most, day), [day], n)


def round_robin(rows: DataFrame, segment: str, n: int) -> DataFrame:
    """n rows in turn from each segment, the newest of each first."""
    turn = F.row_number().over(W.partitionBy(segment).orderBy(F.desc("ts_us"), F.desc("id")))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", segment).limit(n)  # the newest n of a segment are enough


def merged_tags(rows: DataFrame, keys: list[str], position: str = "pos", tag: str = "tag", word: str = "word", score: str = "score") -> DataFrame:
    """Names from tagged words (B-PER, I-PER, O): a run of one kind that no new B begins; mean score.

    Only people, organisations and places count.
    """
    order = W.partitionBy(*keys).orderBy(position)
    kind = F.regexp_extract(tag, "^[BI]-(.*)$", 1)
    rows = rows.withColumns({"__kind": kind, "__b": F.col(tag).startswith("B-")})
    new = F.coalesce(F.col("__b") | (F.col("__kind") != F.lag("__kind").over(order)) | (F.lag(position).over(order) != F.col(position) - 1), F.lit(True))
    rows = rows.withColumn("__new", new.cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    named = rows.where(F.col("__kind").isin("PER", "ORG", "LOC"))
    out = named.groupBy(*keys, "__run", F.col("__kind").alias("kind")).agg(
        F.min(position).alias("begin"), F.max(position).alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, word))), lambda x: x[word]), " ").alias("name"), F.avg(score).alias("score")
    )
    return out.drop("__run")


def without_overlaps(rows: DataFrame, keys: list[str], begin: str = "begin", end: str = "end") -> DataFrame:
    """Spans in order of (begin, end), each kept if it begins where the last kept one has ended or later."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, reach = None, None
        for batch in batches:
            keep = []
            for k, b, e in zip(batch[keys].itertuples(index=False, name=None), batch[begin], batch[end]):
                if k != own:
                    own, reach = k, None
                keep.append(reach is None or b >= reach)
                reach = e if keep[-1] else reach
            yield batch[keep]

    return rows.repartition(*keys).sortWithinPartitions(*keys, begin, end).mapInPandas(fold, rows.schema)


def windows_of_lines(lines: DataFrame, windows: DataFrame, frame: str = "frame") -> DataFrame:
    """Each text line's front-most window that holds its centre.  lines: frame, line, x, y; windows: frame, window, z, left, top, right, bottom."""
    inside = F.col("x").between(F.col("left"), F.col("right")) & F.col("y").between(F.col("top"), F.col("bottom"))
    held = lines.join(windows, frame).where(inside)
    return latest(held, [frame, "line"], "z", "window").select(frame, "line", "window")


def applied_verdicts(verdicts: DataFrame, newest: DataFrame) -> DataFrame:
    """(target, verdict): each verdict on the newest revision of what it names, the last of each; unknown ids are left out.

    verdicts: seq, id, verdict; newest: id, newest.
    """
    named = verdicts.join(newest, "id").select(F.col("newest").alias("target"), "seq", "verdict")
    return latest(named, ["target"], F.desc("seq")).select("target", "verdict")


def bound_evidence(spans: DataFrame, most: int = 8) -> DataFrame:
    """Per packet: whether its spans (packet, event, begin, end, scope) may be cited together, and why not."""
    n = spans.groupBy("packet").agg(F.count("*").alias("n"), F.countDistinct("scope").alias("scopes"), F.countDistinct("event", "begin", "end").alias("different"))
    problem = F.when(F.col("n") > most, "too many").when(F.col("scopes") > 1, "scopes differ").when(F.col("different") < F.col("n"), "duplicate")
    return n.select("packet", "n", problem.alias("problem"))


def project_state(turns: DataFrame, key: str = "session", n: int = 3) -> DataFrame:
    """Per session of a transcript: its goal (the first user line), where it stopped (the last line), questions left open.

    turns: session, turn, role, text.  A question is open if the same role said nothing after it.
    """
    goal = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    out = turns.groupBy(key).agg(goal.alias("goal"), F.max_by("text", "turn").alias("stopped"), F.max_by("role", "turn").alias("by"), F.count("*").alias("turns"))
    return out


def render(rows: DataFrame, keys: list[str], line: str, place: str, tokens: int) -> DataFrame:
    """Lines of each key in order as Markdown, as many as fit a budget of words, with a digest of what was delivered."""
    words = F.size(F.split(F.trim(line), r"\s+"))
    used = F.sum(words).over(W.partitionBy(*keys).orderBy(place).rowsBetween(W.unboundedPreceding, 0))
    fit = rows.withColumn("__used", used).where(F.col("__used") <= tokens)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, line))), lambda x: F.concat(F.lit("- "), x[line])), "\n")
    out = fit.groupBy(*keys).agg(text.alias("markdown"), F.max("__used").alias("tokens"))
    return out.withColumn("digest", F.sha2("markdown", 256))
