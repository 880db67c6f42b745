"""The correspondence network: node and edge statistics, consolidation of variants, export lists. Two shuffles: one by address, one by ordered pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistola.functions import address as A
from epistola.session import Scratch


def _present(c: str) -> Column:
    """A year or id that says something: not null, 0 or empty."""
    return F.when(F.col(c).cast("string").isin("0", ""), None).otherwise(F.col(c))


def years_of(c: str = "year") -> Column:
    return F.array_sort(F.collect_set(_present(c)))


def recipients() -> Column:
    return F.array_union("to_list", "cc_list")


def node_stats(messages: DataFrame) -> DataFrame:
    """``email, sent, received, years, domains``: a sender's count grows by its recipients per message, itself included; a recipient's by one per message, however many
    senders it has; domains are those of its recipients."""
    m = messages.withColumn("to", recipients())
    sent = m.select(F.explode("from_list").alias("email"), F.size("to").cast("long").alias("sent"), F.lit(0).cast("long").alias("received"), "year", F.array_distinct(F.transform("to", A.domain_of)).alias("domains"))
    got = m.select(F.explode("to").alias("email"), F.lit(0).cast("long").alias("sent"), F.lit(1).cast("long").alias("received"), "year", F.expr("cast(array() as array<string>)").alias("domains"))
    both = sent.unionByName(got)
    return both.groupBy("email").agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"), years_of().alias("years"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("domains")))).alias("domains"))


def pairs(messages: DataFrame) -> DataFrame:
    """Sender and recipient of each message, one row per ordered pair, without self-loops."""
    m = messages.select("hash_id", "year", F.explode("from_list").alias("source"), recipients().alias("to"))
    return m.select("hash_id", "year", "source", F.explode("to").alias("target")).where("source <> target")


def edge_stats(messages: DataFrame) -> DataFrame:
    """``source, target, weight, years, doc_ids``: one per message and ordered pair."""
    return pairs(messages).groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"), years_of().alias("years"), F.array_sort(F.collect_set(_present("hash_id"))).alias("doc_ids"))


def display_names(messages: DataFrame) -> DataFrame:
    """``email, name``: the name in the message of least id that gives one."""
    n = messages.select("hash_id", F.explode("display_names").alias("email", "name"))
    return n.groupBy("email").agg(F.min_by("name", F.struct("hash_id", "name")).alias("name"))


def variant_map(emails: DataFrame) -> DataFrame:
    """``email, canon``: the least variant that shares an address's canonical key."""
    keyed = emails.select("email").distinct().withColumn("key", A.canonical_address("email"))
    return keyed.join(keyed.groupBy("key").agg(F.min("email").alias("canon")), "key").select("email", "canon")


def consolidate_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes merged under their canonical address; ids the mapping lacks stay as they are."""
    m = nodes.join(mapping, "email", "left").withColumn("canon", F.coalesce("canon", "email"))
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return m.groupBy("canon").agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"), merged("years").alias("years"), merged("domains").alias("domains"), F.array_sort(F.collect_set("email")).alias("aliases")).withColumnRenamed("canon", "email")


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends mapped and self-loops left out, merged by pair. ``mapping``: ``email, canon``."""
    ends = edges
    for end in ("source", "target"):
        ends = ends.join(mapping.select(F.col("email").alias(end), F.col("canon").alias(f"c_{end}")), end, "left").withColumn(end, F.coalesce(f"c_{end}", end)).drop(f"c_{end}")
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(c), F.array())))))
    out = ends.where("source <> target").groupBy("source", "target")
    return out.agg(F.sum(F.coalesce(F.col("weight"), F.lit(1))).alias("weight"), merged("years").alias("years"), merged("doc_ids").alias("doc_ids"))


def export_nodes(nodes: DataFrame, names: DataFrame, mapping: DataFrame, min_count: int = 1) -> DataFrame:
    """The node list: ``id, name, domain, sent, received, count, years, domain_count, aliases``. The name is the one of the least variant that has one, else made from the address."""
    named = names.join(mapping, "email", "left").withColumn("canon", F.coalesce("canon", "email")).groupBy("canon").agg(F.min_by("name", "email").alias("known")).withColumnRenamed("canon", "email")
    active = nodes.withColumn("count", F.col("sent") + F.col("received")).where(F.col("count") >= min_count)
    return active.join(named, "email", "left").select(
        F.col("email").alias("id"), F.coalesce("known", A.name_from_address("email")).alias("name"), A.domain_of("email").alias("domain"), "sent", "received", "count", "years", F.size("domains").cast("long").alias("domain_count"), "aliases"
    )


def export_edges(edges: DataFrame, nodes: DataFrame, min_weight: int = 1) -> DataFrame:
    """Edges of enough weight whose ends are both in ``nodes``."""
    ids = nodes.select("id")
    kept = edges.where(F.col("weight") >= min_weight)
    for end in ("source", "target"):
        kept = kept.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return kept


def top_domains(nodes: DataFrame, limit: int = 50) -> DataFrame:
    """The domains of most nodes, empty ones left out."""
    return nodes.where("domain <> ''").groupBy("domain").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "domain").limit(limit)


def parsed_once(documents: DataFrame) -> tuple[DataFrame, Scratch]:
    """The messages of mails as a stored table, for plans that read them several times; parsing is most of their cost."""
    from epistola.operators.headers import parse_messages

    scratch = Scratch(documents.sparkSession, "network")
    return scratch.save(parse_messages(documents)), scratch


def build_network(documents: DataFrame, max_docs: int | None = None, min_count: int = 1, min_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a document table. ``max_docs`` caps the mails by least ``hash_id``. The texts are read and parsed once."""
    from epistola.operators.headers import header_filter

    docs = documents.where(header_filter())
    if max_docs:
        docs = docs.orderBy("hash_id").limit(max_docs)
    messages, scratch = parsed_once(docs)
    stats = scratch.save(node_stats(messages))
    mapping = variant_map(stats)
    nodes = export_nodes(consolidate_nodes(stats, mapping), display_names(messages), mapping, min_count)
    edges = export_edges(remap_edges(edge_stats(messages), mapping), nodes, min_weight)
    return nodes, edges
