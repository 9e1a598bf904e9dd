"""Which names, addresses, numbers and hosts are one identity.

A core is a normalised name of a person (two words at least), an organisation or
a place; two different names are never one core.  Everything else is a leaf: it
joins one core or none, so it never links two.  Rules run in stages, and each
is an equi-join with what the stages before it attached:

1. a one-word name joins the only person whose name has the word (0.8);
2. an address whose local part spells a person's name joins that person (0.9).
   Where two persons fit, only one that occurs beside the address in a moment
   is taken; where one person has fitting addresses of two domains, each must occur beside the
   person.  An initial and a last name (0.75) must always occur together;
3. a number joins the only person beside whom it occurs (0.7);
4. a host joins the organisation of its name (0.7);
5. an address or number left over that occurs in two moments is an identity of its own (0.6).

Within a stage leaves are decided in the order of their ids, and a leaf attached
earlier counts as its core.  A stage therefore repeats until nothing changes:
a leaf depends on leaves before it alone, so there is one such result, the
same as taking them one by one.

"Beside" never pairs the mentions of a moment: addresses and hosts meet cores on
(moment, key of the name), numbers take the least and largest core of a moment
over a window.  Words that many names have are counted first and dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.ids import stable_id
from tidelog.operators.graph import HONORIFICS

#: Kinds of entities that are resolved; any other, secrets' marks among them, is left out.
NAMED = {"person_name": "person", "organization": "org", "location": "location"}
HANDLES = ("email", "phone")
KINDS = (*NAMED, *HANDLES, "url")
#: How sure each rule is.
CONFIDENCE = {
    "anchor": 1.0, "exact_name": 1.0, "name_variant": 0.8, "email_name": 0.9, "email_initial": 0.75,
    "phone_cooccur": 0.7, "domain_org": 0.7, "handle_anchor": 0.6,
}
#: Suffixes of hosts under which names are registered, of two labels.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "id.au", "co.nz", "org.nz", "net.nz",
    "govt.nz", "ac.nz", "co.za", "org.za", "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "com.br",
    "net.br", "org.br", "gov.br", "co.in", "net.in", "org.in", "gov.in", "ac.in", "com.cn",
    "net.cn", "org.cn", "gov.cn", "com.sg", "edu.sg", "gov.sg", "com.hk", "org.hk", "com.mx",
    "com.tr", "com.tw", "co.kr", "or.kr", "com.ar", "com.pl", "com.ua",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _small(text: Column) -> Column:
    """A-Z as a-z; other letters stay, so that no two names become equal by folding alone."""
    return F.translate(text, _UPPER, _LOWER)


def name_words(name: Column) -> Column:
    """A name's words in lower case, forms of address at its beginning dropped while another word remains."""
    words = F.regexp_extract_all(_small(F.coalesce(name, F.lit(""))), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))
    title = F.transform(words, lambda w: w.isin(*HONORIFICS))
    first = F.array_position(title, False)  # 0: titles alone
    begin = F.when(first == 0, F.size(words)).otherwise(first).cast("int")
    return F.when(F.size(words) > 1, F.slice(words, F.greatest(begin, F.lit(1)), F.size(words))).otherwise(words)


def display_name(words: Column) -> Column:
    big = lambda w: F.concat(F.translate(F.left(w, F.lit(1)), _LOWER, _UPPER), F.substring(w, F.lit(2), F.length(w)))
    return F.array_join(F.transform(words, big), " ")


def email_parts(email: Column) -> Column:
    """(words of the local part, domain) of an address; null unless it has just one @ between something."""
    small = F.trim(_small(email))
    local, domain = F.split_part(small, F.lit("@"), F.lit(1)), F.split_part(small, F.lit("@"), F.lit(2))
    words = F.filter(F.transform(F.split(local, r"[._+-]"), lambda p: F.regexp_replace(p, r"[0-9]+$", "")), lambda p: p != "")
    whole = (F.length(small) - F.length(F.replace(small, F.lit("@"), F.lit(""))) == 1) & (local != "") & (domain != "")
    return F.when(whole, F.struct(words.alias("words"), domain.alias("domain")))


def host_label(url: Column) -> Column:
    """The registered label of an address's host, null without one."""
    small = F.trim(_small(url))
    after = F.regexp_replace(small, r"^.*?://", "")
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    host = F.regexp_replace(F.split_part(F.regexp_extract(host, r"([^@]*)$", 1), F.lit(":"), F.lit(1)), r"^www\.", "")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    numeric = F.forall(labels, lambda x: x.rlike(r"^[0-9]+$"))
    two = F.concat_ws(".", F.get(labels, n - 2), F.get(labels, n - 1))
    return F.when((n >= 2) & ~numeric, F.get(labels, F.when((n >= 3) & two.isin(*SUFFIXES), n - 3).otherwise(n - 2)))


def _keys(words: Column) -> Column:
    """What spells a name: the set of its words, and its letters run together."""
    return F.array(F.concat(F.lit("set "), F.array_join(F.array_sort(F.array_distinct(words)), " ")), F.concat(F.lit("run "), F.array_join(words, "")))


class Resolver:
    """The stages over one table of entities and one of mentions; `keep` writes an intermediate result."""

    def __init__(self, entities: DataFrame, mentions: DataFrame, keep: Callable[[DataFrame], DataFrame]):
        known = entities.where(F.col("kind").isin(*KINDS) & F.col("id").isNotNull() & F.col("name").isNotNull())
        self.keep, self.entities = keep, keep(known.groupBy("id").agg(F.min(F.struct("kind", "name")).alias("e")).select("id", "e.*"))
        self.mentions = keep(mentions.where("event is not null").select("id", "event").distinct().join(self.entities.select("id"), "id", "left_semi"))
        self.attached = None  # (id, core, rule)

    def kind(self, *kinds: str) -> DataFrame:
        return self.entities.where(F.col("kind").isin(*kinds))

    def attach(self, rows: DataFrame, rule: str | None = None) -> None:
        rows = rows if rule is None else rows.withColumn("rule", F.lit(rule))
        rows = rows.select("id", "core", "rule")
        self.attached = self.keep(rows if self.attached is None else self.attached.unionByName(rows))

    def settled(self, decide: Callable[[DataFrame], DataFrame], sure: DataFrame | None, leaves: DataFrame) -> DataFrame:
        """(id, core) that decide((id, core) attached in this stage so far) comes to; sure: attached whatever the others do."""
        now = self.keep(leaves.select("id").where(F.lit(False)).withColumn("core", F.lit("")))
        if leaves.isEmpty():
            return now if sure is None else sure
        first = True
        while True:
            base = now if sure is None else now.unionByName(sure)
            new = self.keep(decide(base).select("id", "core"))
            if first and new.isEmpty():
                return base
            first = False
            if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
                return base
            now = new

    def beside(self, leaves: DataFrame, cores: DataFrame, sure: DataFrame | None = None) -> DataFrame:
        """(id, core) of leaves (id, key) that occur with just one of the cores (core, key) of their key."""
        cores, leaves = self.keep(cores.distinct()), self.keep(leaves.distinct())
        before = self.mentions.join(self.attached, "id").select("event", "core", F.lit("").alias("first"))
        places = leaves.join(self.mentions, "id").select("event", "key", "id")

        def decide(same: DataFrame) -> DataFrame:
            there = before.union(self.mentions.join(same, "id").select("event", "core", F.col("id").alias("first")))
            there = there.groupBy("event", "core").agg(F.min("first").alias("first")).join(cores, "core")
            met = places.join(there, ["event", "key"]).where("first < id").select("id", "core").distinct()
            return met.groupBy("id").agg(F.count("*").alias("n"), F.min("core").alias("core")).where("n = 1")

        return self.settled(decide, sure, leaves)

    def beside_one_person(self, leaves: DataFrame) -> DataFrame:
        """(id, core) of leaves (id) that occur with one person and no other."""
        person = self.attached.where(F.col("core").startswith("person:"))
        before = self.mentions.join(person, "id").groupBy("event").agg(F.min("core").alias("low"), F.max("core").alias("high"))
        places = self.keep(leaves.select("id").join(self.mentions, "id"))
        order = W.partitionBy("event").orderBy("id").rowsBetween(W.unboundedPreceding, -1)

        def decide(same: DataFrame) -> DataFrame:
            met = places.join(same, "id", "left").join(before, "event", "left")
            least, most = F.least("low", F.min("core").over(order)), F.greatest("high", F.max("core").over(order))
            met = met.select("id", least.alias("low"), most.alias("high")).groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            return met.where("low = high").select("id", F.col("low").alias("core"))

        return self.settled(decide, None, leaves)


def resolved(entities: DataFrame, mentions: DataFrame, keep: Callable[[DataFrame], DataFrame], least: int = 2, sites: int = 2) -> DataFrame:
    """(identity, identity_kind, identity_name, id, rule, confidence): the members of each identity.

    entities: (id, kind, name), ids strings; mentions: (id, event).  An identity
    of names has `least` members or more; an address or number of its own occurs
    in `sites` moments or more.  keep: writes an intermediate result, such as a
    checkpoint.  Null names and unknown kinds take no part; of rows with one id
    the least counts; repeated mentions count once.
    """
    r = Resolver(entities, mentions, keep)
    typed = F.element_at(F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair]), F.col("kind"))
    named = r.kind(*NAMED).select("id", typed.alias("type"), name_words(F.col("name")).alias("words"))
    named = r.keep(named.withColumn("core", F.concat("type", F.lit(":"), F.array_join("words", " "))).where("size(words) > 0"))
    full = named.where("type <> 'person' or size(words) >= 2")
    cores = r.keep(full.groupBy("core", "type", "words").agg(F.min("id").alias("anchor")))
    rule = F.when(F.col("id") == F.col("anchor"), "anchor").otherwise("exact_name")
    r.attach(full.select("core", "id").join(cores.select("core", "anchor"), "core").select("id", "core", rule.alias("rule")))
    persons, orgs = cores.where("type = 'person'"), cores.where("type = 'org'")

    only = persons.select("core", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.min("core").alias("core")).where("n = 1")
    single = named.where("type = 'person' and size(words) = 1").select("id", F.col("words")[0].alias("word"))
    r.attach(single.join(only, "word"), "name_variant")

    emails = r.kind("email").withColumn("p", email_parts(F.col("name"))).where("p is not null and size(p.words) > 0").select("id", "p.words", "p.domain")
    spelt = r.keep(persons.select("core", F.explode(_keys(F.col("words"))).alias("key")).distinct())
    keyed = r.keep(emails.select("id", F.explode(_keys(F.col("words"))).alias("key")))
    strong = r.keep(keyed.join(spelt, "key").select("id", "core").distinct().groupBy("id").agg(F.count("*").alias("n"), F.min("core").alias("core")))
    r.attach(r.beside(keyed.join(strong.where("n > 1"), "id", "left_semi"), spelt), "email_name")
    one = r.keep(strong.where("n = 1").select("id", "core").join(emails.select("id", "domain"), "id"))
    contested = one.groupBy("core").agg((F.min("domain") < F.max("domain")).alias("contested"))
    one = r.keep(one.join(contested, "core"))
    fitting = one.where("contested").select("id", F.col("core").alias("key"))
    r.attach(r.beside(fitting, fitting.select(F.col("key").alias("core"), "key"), one.where("not contested").select("id", "core")), "email_name")
    initial = persons.select("core", F.concat(F.left(F.col("words")[0], F.lit(1)), F.element_at("words", -1)).alias("key"))
    weak = emails.where("size(words) = 1").join(strong, "id", "left_anti").select("id", F.col("words")[0].alias("key"))
    r.attach(r.beside(weak.join(initial.select("key").distinct(), "key", "left_semi"), initial), "email_initial")

    r.attach(r.beside_one_person(r.kind("phone")), "phone_cooccur")

    hosts = r.keep(r.kind("url").select("id", host_label(F.col("name")).alias("key")).where("key is not null"))
    labels = r.keep(orgs.select("core", F.array_join("words", "").alias("key")))
    count = labels.groupBy("key").agg(F.count("*").alias("n"), F.min("core").alias("core"))
    fits = r.keep(hosts.join(count, "key"))
    r.attach(r.beside(fits.where("n > 1").select("id", "key"), labels, fits.where("n = 1").select("id", "core")), "domain_org")

    often = r.mentions.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("id")
    handles = r.kind(*HANDLES).join(r.attached, "id", "left_anti").join(often, "id", "left_semi")
    handles = handles.select("id", F.concat(F.lit("person:"), "kind", F.lit(":"), "name").alias("core"), F.lit("handle_anchor").alias("rule"), F.lit("person").alias("type"), F.col("name").alias("shown"))
    size = r.attached.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    shown = cores.join(size, "core", "left_semi").select("core", "type", display_name(F.col("words")).alias("shown"))
    members = r.attached.join(shown, "core").select("id", "core", "rule", "type", "shown").unionByName(handles)
    key = F.substring(F.col("core"), F.length("type") + 2, F.length("core"))
    sure = F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), F.col("rule"))
    rule = F.when(F.col("rule") == "email_initial", "email_name").otherwise(F.col("rule"))
    return members.select(stable_id(F.lit("identity"), F.col("type"), key).alias("identity"), F.col("type").alias("identity_kind"), F.col("shown").alias("identity_name"), "id", rule.alias("rule"), sure.alias("confidence"))


def with_identities(mentions: DataFrame, members: DataFrame) -> DataFrame:
    """mentions (id, ...) with identity and rule, null for an entity that is in none."""
    return mentions.join(members.select("id", "identity", "rule"), "id", "left")


def same_identity(ids: DataFrame, members: DataFrame) -> DataFrame:
    """(id): the given entities and all members of their identities."""
    own = members.join(ids.select("id").distinct(), "id", "left_semi").select("identity").distinct()
    return ids.select("id").union(members.join(own, "identity", "left_semi").select("id")).distinct()


def events_of_identity(mentions: DataFrame, members: DataFrame) -> DataFrame:
    """(identity, event, mentions): the moments in which any member of an identity occurs."""
    return mentions.join(members.select("id", "identity"), "id").groupBy("identity", "event").agg(F.count("*").alias("mentions"))
