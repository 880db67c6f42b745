"""From a resolved alias map to a smaller graph: display ids, merged nodes and edges, report and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistola.functions import address as A
from epistola.functions import rules
from epistola.operators.network import remap_edges
from epistola.operators.resolve import parts, words


def node_score() -> Column:
    """The order in which one node represents its group: traffic, clean domain, a dot in the local part, name quality, short id, and the least id."""
    d, n = F.coalesce("domain", F.lit("")), F.coalesce("name", F.lit(""))
    clean = d.isin("epa.gov", "gmail.com", "yahoo.com") | (d.endswith(".gov") & ~d.rlike("[q30]"))
    marks = F.lower(n).rlike("rn|ii|0|1|3").cast("int")
    quality = F.when(n == "", 0).otherwise(F.when(words("name") >= 2, 2).otherwise(0) + ((n == A.title(n)) | (n == F.upper(n))).cast("int") - marks)
    return F.struct(F.coalesce("count", F.lit(0)).alias("count"), clean.cast("int").alias("clean"), A.local_of("id").contains(".").cast("int").alias("dot"), quality.alias("quality"), (-F.length("id")).alias("short"))


def best_ids(alias_map: DataFrame, nodes: DataFrame, address_repairs: dict[str, str] | None = None, domain_repairs: dict[str, str] | None = None) -> DataFrame:
    """``orig_id, best_id``: each group's best node, its address cleaned for display. Groups that clean to one address become one. The tables are those of
    the resolution."""
    scored = alias_map.join(nodes.withColumnRenamed("id", "orig_id").withColumn("id", F.col("orig_id")), "orig_id").withColumn("score", node_score())
    top = scored.groupBy("canon").agg(F.max("score").alias("score"))
    best = scored.join(top, ["canon", "score"]).groupBy("canon").agg(F.min("orig_id").alias("best"))
    shown = A.with_local(A.with_domain(A.structural("best", address_repairs or {}), lambda d: A.match_domain(d, domain_repairs)), A.display_local)
    return alias_map.join(best.select("canon", shown.alias("best_id")), "canon").select("orig_id", "best_id")


def display_name(named: DataFrame, by: str = "best_id") -> DataFrame:
    """``by, name``: most frequent by traffic among names of two words in title case first; scanning marks, then the name, decide ties."""
    n = named.where("name IS NOT NULL AND name <> ''").groupBy(by, "name").agg(F.sum(F.coalesce("count", F.lit(1))).alias("freq"))
    marks = sum((F.lower("name").contains(p).cast("int") for p in ("rn", "ii", "vv", "ffl", "svd", "liav")), F.lit(0))
    top = n.withColumn("s", F.struct((words("name") >= 2).alias("w"), (F.col("name") == A.title("name")).alias("t"), "freq", (-marks).alias("m")))
    best = top.groupBy(by).agg(F.max("s").alias("s"))
    return top.join(best, [by, "s"]).groupBy(by).agg(F.min("name").alias("name"))


def split_initial(n: Column) -> Column:
    """``F. Rest`` for a single capitalised word of five letters or more that is neither a first name nor a role."""
    known = [*rules.FIRST_NAMES, *rules.GENERIC_LOCALS]
    return F.when((F.length(n) >= 5) & n.rlike(r"^\p{Lu}\S{3,}$") & ~F.lower(n).isin(known), F.concat(F.substring(n, 1, 1), F.lit(". "), A.title(F.substring(n, 2, 1 << 16))))


def name_from_id(i: Column) -> Column:
    p = parts(A.local_of(i))
    one = A.title(F.get(p, F.lit(0)))
    out = F.when(F.size(p) == 1, F.when(F.lower(F.get(p, F.lit(0))).isin(*rules.GENERIC_LOCALS), F.lit("")).otherwise(F.coalesce(split_initial(one), one)))
    return F.when(A.has_at(i) & (F.size(p) > 0), out.otherwise(F.array_join(F.transform(p, A.title), " "))).otherwise("")


def fixed_order(name: Column, i: Column, domain: Column) -> Column:
    """A name of two words that stand as in an address of a domain that puts last names first, turned round."""
    w, p = F.filter(F.split(name, r"\s+"), lambda x: F.length(x) > 0), parts(A.local_of(i))
    turned = domain.isin(*rules.LAST_NAME_FIRST) & (F.size(w) == 2) & (F.size(p) == 2) & (F.lower(F.get(w, F.lit(0))) == F.get(p, F.lit(0))) & (F.lower(F.get(w, F.lit(1))) == F.get(p, F.lit(1)))
    return F.when(turned, F.concat(F.get(w, F.lit(1)), F.lit(" "), F.get(w, F.lit(0)))).otherwise(name)


def merge_nodes(nodes: DataFrame, best: DataFrame, domain_repairs: dict[str, str] | None = None) -> DataFrame:
    """Nodes merged by best id: sums, united years, greatest ``domain_count``, sorted aliases."""
    m = best.join(nodes.withColumnRenamed("id", "orig_id"), "orig_id")
    years = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("years", F.expr("cast(array() as array<int>)"))))))
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    g = m.groupBy("best_id").agg(zero("sent"), zero("received"), zero("count"), years.alias("years"), F.max(F.coalesce("domain_count", F.lit(0))).alias("domain_count"), F.array_sort(F.collect_set("orig_id")).alias("aliases"))
    named = g.join(display_name(m), "best_id", "left").withColumn("domain", A.match_domain(A.rest_of("best_id"), domain_repairs))
    name = F.coalesce("name", name_from_id(F.col("best_id")))
    name = F.coalesce(split_initial(name), name)
    return named.select(F.col("best_id").alias("id"), fixed_order(name, F.col("best_id"), F.col("domain")).alias("name"), "domain", "sent", "received", "count", "years", "domain_count", "aliases")


def merge_edges(edges: DataFrame, best: DataFrame) -> DataFrame:
    return remap_edges(edges, best.select(F.col("orig_id").alias("email"), F.col("best_id").alias("canon")))


def merge_report(best: DataFrame, limit: int = 100) -> DataFrame:
    """The largest groups of more than one id."""
    g = best.groupBy("best_id").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_set("orig_id")).alias("aliases"))
    return g.where("size > 1").orderBy(F.desc("size"), "best_id").limit(limit)


def invariants(nodes: DataFrame, merged: DataFrame, edges: DataFrame) -> DataFrame:
    """``check, bad``: 0 where traffic is conserved, edge ends exist, no edge is a loop and ids are unique."""
    spark = nodes.sparkSession
    ids = merged.select("id")
    total = lambda d: d.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    conserved = total(nodes.where("id IS NOT NULL")).crossJoin(total(merged).withColumnRenamed("n", "m")).select(F.lit("count_conserved").alias("check"), F.abs(F.col("n") - F.col("m")).alias("bad"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).join(ids, "id", "left_anti").agg(F.count(F.lit(1)).alias("bad")).select(F.lit("ends_exist").alias("check"), "bad")
    loops = edges.where("source = target").agg(F.count(F.lit(1)).alias("bad")).select(F.lit("no_loops").alias("check"), "bad")
    unique = merged.groupBy("id").count().where("count > 1").agg(F.count(F.lit(1)).alias("bad")).select(F.lit("unique_ids").alias("check"), "bad")
    return conserved.unionByName(ends).unionByName(loops).unionByName(unique)
