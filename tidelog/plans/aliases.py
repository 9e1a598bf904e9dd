"""Queries of identities: who is who in the given texts, and recall by any of their names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import aliases as a
from tidelog.operators import extract as x
from tidelog.operators.textindex import NAME
from tidelog.plans.registry import query
from tidelog.sources.tables import checkpointed, table


def named_entities(spark, sf):
    """(id, kind, name, event): names, addresses, numbers and links in documents, and the source of each as an organisation."""
    docs = table(spark, sf, "documents")
    found = x.mentions(docs, "doc_id").where(F.col("kind").isin("email", "phone", "url")).select("kind", "name", F.col("doc_id").alias("event"))
    names = docs.select(F.lit("person_name").alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))).alias("name"), F.col("doc_id").alias("event"))
    orgs = docs.where("source is not null").select(F.lit("organization").alias("kind"), F.col("source").alias("name"), F.col("doc_id").alias("event"))
    return found.unionByName(names).unionByName(orgs).select(F.md5(F.concat_ws("|", "kind", "name").cast("binary")).alias("id"), "kind", "name", "event")


def members(spark, sf):
    keep = checkpointed(spark)
    rows = keep(named_entities(spark, sf))
    return rows, keep(a.resolved(rows.select("id", "kind", "name"), rows.select("id", "event"), keep))


@query()
def alias_resolution(spark, sf):
    """Identities among the entities of all texts."""
    return members(spark, sf)[1]


@query()
def mention_identities(spark, sf):
    """Every mention with its identity, if it has one."""
    rows, found = members(spark, sf)
    return a.with_identities(rows, found).select("id", "kind", "name", "event", "identity", "rule")


@query()
def identity_events(spark, sf):
    """The moments of each identity."""
    rows, found = members(spark, sf)
    return a.events_of_identity(rows.select("id", "event"), found)
