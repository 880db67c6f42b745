"""Problem 5: the best representative of each duplicate group, built from consistent bundles.

Fields that depend on each other are chosen as a whole. The *name bundle* is a first and a last name together; the *address bundle* is a whole
address. Two functional dependencies tie them: name -> local part (the address must spell the chosen name whole and undamaged) and
organisation -> domain (its domain must be a known one). A survivor is a pair of bundles; its worth is compared in this order: a name that some
field spells whole, an address that keeps both dependencies, trust (three for every field that spells the bundle, one for every field
that agrees in its first or its last name), undamaged fields.

The search is branch and bound in three aggregate steps, so that a group of any size never comes together in one task:

1. *Bound.* Bundles are counted, and each gets the worth of a survivor that keeps the dependencies: no address can make it better.
2. *Dive.* The bundle of the greatest bound in a group is followed to its leaf: its spellings are looked up among the group's addresses.
   The leaf's worth is the incumbent.
3. *Branch.* Only bundles whose bound beats their group's incumbent are followed as well. In most groups there are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistola.llm.personname import read_local, read_name
from epistola.session import Scratch, maybe_broadcast

_FIELDS = "id string, field string, first string, full boolean, middle string, last string, clean boolean"


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per field that names a person: the name and the local part of the address."""
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    kinds = [pa.bool_() if n in ("full", "clean") else pa.string() for n in names]
    for b in batches:
        rows = []
        for id_, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n = read_name(name)
            if n and n.org is None:
                # A name with a gap in it or letters of figures is damaged, whatever it reads as.
                clean = "  " not in name.strip() and not any(c.isdigit() for c in name)
                rows.append((id_, "name", n.first or n.initial, bool(n.first and n.raw == n.first), n.middle, n.last, clean))
            p = read_local(id_.partition("@")[0], n)
            if p and p.org is None:
                full = bool(p.first and (p.raw or p.first) == p.first and p.exact)
                rows.append((id_, "local", p.first or p.initial, full, None, p.last, not any(c.isdigit() for c in id_)))
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def _title(c: str):
    return F.initcap(F.col(c))


def spellings():
    """The local parts that spell a first and a last name whole: joined by a full stop, underscore, hyphen or nothing, either one first."""
    return F.array(*[F.concat(x, F.lit(sep), y) for sep in (".", "_", "-", "") for x, y in (("first", "last"), ("last", "first"))])


def worth(fits):
    """What bundles are compared by; the names settle ties, so that no two bundles of a group are worth the same."""
    return F.struct("full", fits.alias("fits"), "trust", "n_clean", "everywhere", F.col("last").alias("l"), F.coalesce("first", F.lit("")).alias("f"))


def leaves(bundles: DataFrame, locals_: DataFrame) -> DataFrame:
    """``canon, first, last, leaf``: the worth of bundles with the addresses of their group; ``locals_``: ``canon, local`` of those in known domains."""
    spelt = bundles.where("first IS NOT NULL").select("canon", "first", "last", F.explode(spellings()).alias("local"))
    found = spelt.join(locals_, ["canon", "local"], "left_semi").select("canon", "first", "last").distinct().withColumn("fits", F.lit(True))
    same = (F.col("b.canon") == F.col("f.canon")) & (F.col("b.last") == F.col("f.last")) & (F.col("b.first") == F.col("f.first"))
    return bundles.alias("b").join(found.alias("f"), same, "left").select("b.*", F.coalesce("f.fits", F.lit(False)).alias("fits")).select("canon", "first", "last", worth(F.col("fits")).alias("leaf"))


def search(scratch: Scratch, bundles: DataFrame, locals_: DataFrame) -> DataFrame:
    """``canon, last, first`` of the best bundle of each group by branch and bound (see above)."""
    bound = bundles.withColumn("bound", worth(F.lit(True)))
    top = bound.groupBy("canon").agg(F.max_by(F.struct("first", "last", "full", "trust", "n_clean", "everywhere"), "bound").alias("t"))
    dive = scratch.save(leaves(top.select("canon", "t.*"), locals_))
    incumbent = dive.select("canon", F.col("leaf").alias("bar"))
    open_ = bound.join(incumbent.where("NOT bar.fits"), "canon").where((F.col("bound") > F.col("bar")) & ((F.col("last") != F.col("bar.l")) | (F.coalesce("first", F.lit("")) != F.col("bar.f"))))
    branched = leaves(open_.drop("bound", "bar"), locals_)
    return dive.unionByName(branched).groupBy("canon").agg(F.max_by(F.struct("last", "first"), "leaf").alias("b")).select("canon", "b.last", "b.first")


def survivors(alias_map: DataFrame, nodes: DataFrame, domains: DataFrame) -> DataFrame:
    """``(canon, id, name, total)``, one row per ``alias_map.canon``.

    Repeated rows of either table count once (of repeated node ids the row with the greatest count). Ids that ``nodes`` lacks add nothing; a
    group of none has null ``id`` and ``name`` and total 0. If no address fits the chosen name in a known domain, the most
    trusted of the others is taken. Ties go to the address in use last, then to the smallest; of names and middle initials equally
    often given to the smallest. Null counts are 0, null or empty ``years`` are never. Extra columns are ignored.
    """
    scratch = Scratch(nodes.sparkSession, "survivor")
    groups = alias_map.select(F.col("orig_id").alias("id"), "canon").where("canon IS NOT NULL").distinct()
    own = nodes.where("id IS NOT NULL").select("id", "name", "domain", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce(F.array_max("years"), F.lit(-1)).alias("last_year"))
    own = own.groupBy("id").agg(F.max(F.struct("count", "last_year", "domain", "name")).alias("r")).select("id", "r.name", "r.domain", "r.count", "r.last_year")
    rows = scratch.save(groups.join(own, "id"))
    fields = scratch.save(rows.select("id", "name").distinct().mapInArrow(_fields, _FIELDS))
    said = rows.select("canon", "id").join(fields, "id")
    # How often a surname is spelt so in the whole table settles ties within small groups.
    spelt = fields.groupBy("last").agg(F.count(F.lit(1)).alias("everywhere"))
    counted = said.groupBy("canon", "first", "full", "last").agg(F.count(F.lit(1)).alias("n"), F.count_if("clean").alias("n_clean"))
    lasts = counted.groupBy("canon", "last").agg(F.sum("n").alias("n_last"))
    firsts = counted.groupBy("canon", "first").agg(F.sum("n").alias("n_first"))
    bundles = counted.where("last IS NOT NULL").groupBy("canon", "first", "last").agg(F.max("full").alias("full"), F.sum("n").alias("n"), F.sum("n_clean").alias("n_clean"))
    bundles = bundles.join(lasts, ["canon", "last"]).join(firsts.where("first IS NOT NULL"), ["canon", "first"], "left").fillna(0, ["n_first"]).join(maybe_broadcast(spelt), "last")
    bundles = scratch.save(bundles.select("canon", "first", "last", "full", (3 * F.col("n") + F.col("n_last") + F.col("n_first")).alias("trust"), "n_clean", "everywhere"))
    known = domains.select(F.col("domain").alias("known")).where("known IS NOT NULL").distinct()
    able = rows.select("canon", "id", "last_year").join(maybe_broadcast(known), F.substring_index("id", "@", -1) == F.col("known"), "left")
    able = scratch.save(able.select("canon", "id", F.substring_index("id", "@", 1).alias("local"), "last_year", F.col("known").isNotNull().alias("known")))
    chosen = search(scratch, bundles, able.where("known").select("canon", "local").distinct())
    # A short form or an initial in all names stands for the full name that an address of the group spells.
    middles = said.where("field = 'name' AND middle IS NOT NULL").join(maybe_broadcast(chosen.select("canon", F.col("first").alias("cf"))), "canon")
    middles = middles.where("first = cf OR substring(first, 1, 1) = substring(cf, 1, 1)").groupBy("canon", "middle").agg(F.count(F.lit(1)).alias("n"))
    middle = middles.groupBy("canon").agg(F.max_by("middle", F.struct("n", F.negative(F.ascii("middle")))).alias("middle"))
    chosen = scratch.save(chosen.join(middle, "canon", "left"))
    given = F.when(F.length("first") > 1, _title("first")).when(F.col("first").isNotNull(), F.concat(F.upper("first"), F.lit(".")))
    named = chosen.withColumn("name", F.concat_ws(" ", given, F.when(F.col("middle").isNotNull(), F.concat(F.upper("middle"), F.lit("."))), _title("last")))
    spelling = named.where("first IS NOT NULL").select("canon", F.explode(spellings()).alias("local")).distinct().withColumn("exact", F.lit(True))
    able = able.join(spelling, ["canon", "local"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    fits = F.col("exact") & F.col("known")
    able = able.withColumn("fit", F.struct(fits.alias("fits"), F.when(fits, F.col("last_year")).otherwise(0).alias("y"), F.col("exact").alias("x"), F.col("known").alias("k"), F.col("last_year").alias("z")))
    top = able.groupBy("canon").agg(F.max("fit").alias("fit"))
    address = able.join(top, ["canon", "fit"]).groupBy("canon").agg(F.min("id").alias("id"))
    total = rows.groupBy("canon").agg(F.sum("count").alias("total"))
    out = groups.select("canon").distinct().join(address, "canon", "left").join(named.select("canon", "name"), "canon", "left").join(total, "canon", "left")
    return out.select("canon", "id", "name", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
