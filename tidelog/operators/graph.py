"""Entities and episodes as a graph: identities, links, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import tokens

#: Forms of address that begin a name.
HONORIFICS = ("mr", "mrs", "ms", "mx", "miss", "dr", "prof", "professor", "sir", "madam", "rev")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other): both ends of each edge; an undirected edge is two directed ones, so the join stays an equi-join."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    return both.join(nodes, "node", "left_semi").distinct()


def consolidated(pairs: DataFrame) -> DataFrame:
    """Edges between episodes from pairs (episode_a, episode_b, identity, ts_a, ts_b): sorted evidence, latest time."""
    ends = [F.least("episode_a", "episode_b").alias("src"), F.greatest("episode_a", "episode_b").alias("dst")]
    grouped = pairs.where("episode_a <> episode_b").groupBy(*ends)
    return grouped.agg(F.sort_array(F.collect_set("identity")).alias("evidence"), F.max(F.greatest("ts_a", "ts_b")).alias("ts_us"))


def normal_name(name):
    """A person's name as tokens in lower case, leading forms of address dropped while more than one token remains."""
    step = lambda kept, word: F.when((F.size(kept) == 0) & word.isin(*HONORIFICS), kept).otherwise(F.concat(kept, F.array(word)))
    words = tokens(name)
    kept = F.aggregate(words, F.array().cast("array<string>"), step)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(words, F.greatest(F.size(words), F.lit(1)), F.lit(1)))


def local_tokens(email):
    """The local part of an address as tokens, digits at its end dropped."""
    local = F.regexp_replace(F.lower(F.split_part(email, F.lit("@"), F.lit(1))), r"[0-9]+$", "")
    return F.filter(F.split(local, r"[._+-]"), lambda x: x != "")


def email_matches(persons: DataFrame, emails: DataFrame) -> DataFrame:
    """(email_id, person_id, rule, confidence): addresses whose tokens are a person's.

    Exact: the same set of tokens, or the same letters run together (0.9).
    Initial: the first letter before the last name (0.75), for one person only.
    Each rule is an equi-join on a key made of the name.
    """
    p = persons.select(F.col("id").alias("person_id"), normal_name(F.col("name")).alias("t")).where(F.size("t") >= 2)
    e = emails.select(F.col("id").alias("email_id"), local_tokens(F.col("email")).alias("t")).where(F.size("t") >= 1)
    same = lambda t: F.array_join(F.array_sort(t), " ")
    run = lambda t: F.array_join(t, "")
    initial = lambda t: F.concat(F.left(t[0], F.lit(1)), F.element_at(t, -1))
    by_set = e.select("email_id", same(F.col("t")).alias("k")).join(p.select("person_id", same(F.col("t")).alias("k")), "k")
    by_run = e.select("email_id", run(F.col("t")).alias("k")).join(p.select("person_id", run(F.col("t")).alias("k")), "k")
    exact = by_set.select("email_id", "person_id").union(by_run.select("email_id", "person_id")).distinct()
    rest = e.join(exact, "email_id", "left_anti")
    by_initial = rest.select("email_id", F.explode("t").alias("k")).join(p.select("person_id", initial(F.col("t")).alias("k")), "k").select("email_id", "person_id").distinct()
    only = by_initial.groupBy("email_id").agg(F.count("*").alias("n"), F.min("person_id").alias("person_id")).where("n = 1").select("email_id", "person_id")
    return exact.withColumns({"rule": F.lit("email_exact"), "confidence": F.lit(0.9)}).union(only.withColumns({"rule": F.lit("email_initial"), "confidence": F.lit(0.75)}))


def domain_matches(organisations: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, org_id): hosts whose registrable label is the organisation's name run together."""
    label = F.element_at(F.split(F.regexp_replace("host", r"\.(co|com|org|net|gov|ac)\.[a-z]{2}$|\.[a-z]+$", ""), r"\."), -1)
    named = organisations.select(F.col("id").alias("org_id"), F.array_join(tokens(F.col("name")), "").alias("k"))
    return hosts.select("host", label.alias("k")).join(named, "k").select("host", "org_id")


def identities(anchors: DataFrame, attached: DataFrame) -> DataFrame:
    """(identity, member, rule): anchors (id) and what is attached to them (anchor, id, rule), with two members at least."""
    rows = anchors.select(F.col("id").alias("identity"), F.col("id").alias("member"), F.lit("anchor").alias("rule")).union(attached.select("anchor", "id", "rule"))
    sizes = rows.groupBy("identity").agg(F.countDistinct("member").alias("n")).where("n >= 2")
    return rows.join(sizes, "identity", "left_semi").distinct()


def single_tokens(persons: DataFrame) -> DataFrame:
    """(alias_id, person_id): one-word names attached to the one full name that has the word."""
    p = persons.select("id", normal_name(F.col("name")).alias("t"))
    full = p.where(F.size("t") >= 2).select(F.col("id").alias("person_id"), F.explode(F.array_distinct("t")).alias("k"))
    one = p.where(F.size("t") == 1).select(F.col("id").alias("alias_id"), F.col("t")[0].alias("k"))
    joined = one.join(full, "k").groupBy("alias_id").agg(F.countDistinct("person_id").alias("n"), F.min("person_id").alias("person_id"))
    return joined.where("n = 1").select("alias_id", "person_id")
