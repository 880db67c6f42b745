"""Pair search: the documents in which two correspondents meet, by any of their addresses."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DOCS = 500
DOCUMENT_URL = "https://documents.example.org"


def address_pattern(address: str, anchored: bool = False) -> str:
    """A pattern for an address whose domain may have further labels before its last two. ``anchored`` keeps it from matching the end of a longer local part."""
    if "@" not in address:
        raise ValueError(f"not an address: {address!r}")
    local, domain = address.split("@", 1)
    tail = ".".join(domain.split(".")[-2:])
    return (r"(?<![a-zA-Z0-9._-])" if anchored else "") + re.escape(local) + r"@[a-zA-Z0-9._-]*" + re.escape(tail)


def person_pattern(address: str, aliases: Sequence[str] | None = None, anchored: bool = False) -> str:
    """One pattern for all addresses of a person: the alternation of the aliases if there are several, else the address itself. Aliases without an ``@`` match nothing."""
    good = [a for a in aliases or [] if a and "@" in a]
    if len(good) <= 1:
        return address_pattern(address, anchored)
    return "(?:" + "|".join(address_pattern(a, anchored) for a in good) + ")"


def both_mentioned(one: str, two: str) -> Column:
    return F.col("text").rlike("(?i)" + one) & F.col("text").rlike("(?i)" + two)


def document_url(base: str = DOCUMENT_URL) -> Column:
    h = F.col("hash_id")
    return F.concat(F.lit(base + "/"), F.substring(h, 1, 2), F.lit("/"), h, F.lit("/"), h, F.lit(".pdf"))


def bundle_key(a: str, b: str, prefix: str = "bundles/") -> str:
    return prefix + "___".join(sorted([a, b])) + ".zip"


def correspondence(documents: DataFrame, address1: str, address2: str, aliases1: Sequence[str] | None = None, aliases2: Sequence[str] | None = None, limit: int = MAX_DOCS, anchored: bool = False) -> DataFrame:
    """``hash_id, url`` of documents that mention both persons, the first ``limit`` by id; documents without an id are left out first."""
    hit = documents.where(F.col("hash_id").isNotNull() & (F.col("hash_id") != "") & both_mentioned(person_pattern(address1, aliases1, anchored), person_pattern(address2, aliases2, anchored)))
    return hit.select("hash_id", document_url().alias("url")).orderBy("hash_id").limit(limit)


TOKEN = r"[a-z0-9._%+'-]+@[a-z0-9.-]+"


#: Characters of the stretches by which ids that no token can hold are looked for.
GRAM = 5


def _held(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """The keys that stand in some text. Shorter keys than ``GRAM`` are their own stretch; an empty key stands everywhere."""
    texts = texts.distinct().withColumn("h", F.xxhash64("t"))
    size = F.least(F.length("key"), F.lit(GRAM))
    sizes = [r.n for r in keys.where("key <> ''").select(size.alias("n")).distinct().collect()]  # at most GRAM
    empty = keys.where("key = ''").join(texts.select(F.lit("").alias("key")).limit(1), "key", "left_semi")
    if not sizes:
        return empty
    cuts = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, F.lit(n))))
    own = keys.where("key <> ''").select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - size + 1), lambda i: F.substring(F.col("key"), i, size))).alias("g")).distinct()
    wanted = own.select("g").distinct()
    found = None
    for n in sizes:
        rows = texts.where(F.length("t") >= n).select("h", F.explode(cuts("t", n)).alias("g")).join(wanted, "g", "left_semi")
        found = rows if found is None else found.unionByName(rows)
    often = found.groupBy("g").agg(F.count(F.lit(1)).alias("texts"))
    # A key one of whose stretches stands nowhere stands nowhere itself; of the others the rarest stretch is followed.
    rarest = own.join(often, "g", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("n"), "g")).alias("r")).where("r.n > 0").select("key", F.col("r.g").alias("g"))
    pairs = rarest.join(found, "g").select("key", "h")
    return pairs.join(texts, "h").where(F.contains("t", "key")).select("key").distinct().unionByName(empty)


def unmatched(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """``email, name, count`` of nodes whose address stands in no document, as a substring in any case.

    Documents are cut once into their distinct address-like tokens. A token holds an address if one of the token's stretches around the ``@`` is equal to it: a
    suffix of the token's local part with a prefix of its domain. These stretches are exploded only around tokens whose domain begins with some node's
    domain, so the anti-join is an equality join on (local suffix length, domain). Ids of other characters, which no token can
    hold, are cut into stretches of ``GRAM`` characters; the rarest one of each meets the documents in an equality join, and what meets is verified.
    """
    spark = nodes.sparkSession
    n = nodes.select(F.col("id").alias("email"), "name", "count").where("email IS NOT NULL")
    low = n.withColumn("key", F.lower("email"))
    plain = low.where(F.col("key").rlike("^" + TOKEN + "$"))
    odd = low.where(~F.col("key").rlike("^" + TOKEN + "$"))
    texts = documents.select(F.lower("text").alias("t")).where("t IS NOT NULL")
    tokens = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(f"({TOKEN})"), F.lit(1)))).alias("token")).distinct()
    tokens = tokens.select(F.split_part("token", F.lit("@"), F.lit(1)).alias("l"), F.split_part("token", F.lit("@"), F.lit(2)).alias("d"))
    tails = tokens.select("l", F.explode(F.transform(F.sequence(F.lit(1), F.length("d")), lambda i: F.substring(F.col("d"), F.lit(1), i))).alias("d")).distinct()
    domains = plain.select(F.split_part("key", F.lit("@"), F.lit(2)).alias("d")).distinct()
    near = tails.join(domains, "d", "left_semi")
    stretches = near.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("l")), lambda i: F.concat(F.substring(F.col("l"), i, F.lit(1 << 16)), F.lit("@"), F.col("d")))).alias("key")).distinct()
    missing = plain.join(stretches, "key", "left_anti")
    rest = odd.join(_held(odd.select("key").distinct(), texts), "key", "left_anti")
    return missing.unionByName(rest).select("email", "name", "count").orderBy(F.desc_nulls_last("count"), "email")
