"""Entity resolution of a built graph: nine layers that each turn candidate pairs into merges of canonical addresses.

The state is ``(orig_id, canon)``. A layer reads it, proposes ``(src, dst)`` merges and applies them with chains followed. Candidates come from equality joins on computed
keys; only the fuzzy layers compare within blocks (domain, local part or name), bounded by length. The expensive similarity runs on its own branch of borderline pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistola.functions import address as A
from epistola.functions import rules
from epistola.functions.similarity import jaro_winkler_udf, parts_distance_udf
from epistola.operators.components import components, follow_chains
from epistola.session import Scratch, multiplied

# Thresholds of the fuzzy layers.
NAME_SIMILARITY, TOKEN_SHARE, BUSY, BUSY_RATIO, SAME_NAME, TIMES = 0.85, 0.4, 50, 2.0, 0.95, 5.0


def parts(l: Column, least: int = 2) -> Column:
    return F.filter(F.split(l, r"[._\-]"), lambda p: F.length(p) >= least)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def best_names(originals: DataFrame) -> DataFrame:
    """``canon, name``: of a group's names the best by two words, title case, few scanning marks, traffic, and the name itself. ``originals``: ``canon, name, count``."""
    n = originals.where("name IS NOT NULL AND name <> ''").groupBy("canon", "name").agg(F.sum(F.coalesce("count", F.lit(1))).alias("freq"))
    marks = sum((F.lower("name").contains(p).cast("int") for p in ("rn", "ii", "ffl", "ffi", "0", "1", "3")), F.lit(0))
    return n.groupBy("canon").agg(F.max_by("name", F.struct((words("name") >= 2).alias("w"), (F.col("name") == A.title("name")).alias("t"), (-marks).alias("m"), "freq", "name")).alias("name"))


def words(c: str) -> Column:
    return F.size(F.filter(F.split(F.col(c), r"\s+"), lambda w: F.length(w) > 0))


def name_key(c: str) -> Column:
    """A name's words, lower-case and in order; null with fewer than two."""
    w = F.array_sort(F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda x: F.length(x) > 0))
    return F.when(F.size(w) >= 2, F.array_join(w, " "))


@dataclass
class Resolution:
    """The layers over one graph. ``changes`` counts the ids that each layer moved."""

    nodes: DataFrame
    address_repairs: dict[str, str] = field(default_factory=dict)
    domain_repairs: dict[str, str] | None = None
    generic: frozenset[str] = rules.GENERIC_LOCALS
    first_names: frozenset[str] = rules.FIRST_NAMES
    changes: list[tuple[str, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.scratch = Scratch(self.nodes.sparkSession, "resolve")
        n = self.nodes.where("id IS NOT NULL").groupBy("id").agg(F.max_by("name", F.struct("count", "name")).alias("name"), F.max("count").alias("count"))
        self.known = self._per_node(n)
        self.state = self.known.select(F.col("id").alias("orig_id"), F.col("id").alias("canon"))
        self._canons: tuple[DataFrame, DataFrame] | None = None

    def _per_node(self, df: DataFrame) -> DataFrame:
        """A stored table that grows with the nodes, for sort-merge joins: its compressed files look small enough to broadcast long after its rows are not."""
        return self.scratch.save(df).hint("merge")

    # -- shared views ------------------------------------------------------------------------------------------------

    def canons(self) -> DataFrame:
        """``canon, local, domain, total``: one row per canonical address, with its group's traffic."""
        if self._canons is None or self._canons[0] is not self.state:  # once a layer
            g = self.state.join(self.known.withColumnRenamed("id", "orig_id"), "orig_id").groupBy("canon").agg(F.sum(F.coalesce("count", F.lit(0))).alias("total"))
            rows = g.where(F.col("canon").contains("@")).select("canon", A.local_of("canon").alias("local"), A.rest_of("canon").alias("domain"), "total")
            self._canons = (self.state, self._per_node(rows))
        return self._canons[1]

    def named(self) -> DataFrame:
        own = self.state.join(self.known.withColumnRenamed("id", "orig_id"), "orig_id").select("canon", "name", "count")
        return self.canons().join(best_names(own), "canon", "left")

    def two_part(self) -> DataFrame:
        """``domain, key, target``: canonical addresses with exactly two parts, by their sorted pair; of several the least."""
        p = parts(F.col("local"))
        c = self.canons().where(F.size(p) == 2).select("domain", pair_key(F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("key"), "canon")
        return c.groupBy("domain", "key").agg(F.min("canon").alias("target"))

    # -- application -------------------------------------------------------------------------------------------------

    def project(self, layer: str, f) -> None:
        self._set(layer, self.state.select("orig_id", F.col("canon").alias("before"), f(F.col("canon")).alias("canon")))

    def merge(self, layer: str, merges: DataFrame) -> None:
        final = follow_chains(merges)
        after = self.state.join(final.select(F.col("src").alias("canon"), "dst"), "canon", "left")
        self._set(layer, after.select("orig_id", F.col("canon").alias("before"), F.coalesce("dst", "canon").alias("canon")))

    def _set(self, layer: str, after: DataFrame) -> None:
        new = self.scratch.save(after)
        self.changes.append((layer, new.where("before <> canon").count()))
        self.state = new.select("orig_id", "canon")

    # -- layers ------------------------------------------------------------------------------------------------------

    def structural(self) -> None:
        self.project("structural", lambda c: A.structural(c, self.address_repairs))

    def domain(self) -> None:
        self.project("domain", lambda c: A.with_domain(c, lambda d: A.match_domain(d, self.domain_repairs)))

    def local_characters(self) -> None:
        self.project("local", lambda c: A.with_local(c, lambda l: A.sorted_local(A.match_local(l))))

    def split_locals(self) -> DataFrame:
        """A local part of three parts or more whose parts, joined to two, are a known pair of the domain."""
        first = self.state.groupBy("canon").agg(F.min("orig_id").alias("orig"))
        cleaned = A.with_domain(A.structural("orig", self.address_repairs), lambda d: A.match_domain(d, self.domain_repairs))
        p = first.where(F.col("canon").contains("@")).select("canon", A.rest_of("canon").alias("domain"), parts(A.local_of(cleaned)).alias("p")).where(F.size("p") >= 3)
        s = lambda l, r: F.struct(l.alias("l"), r.alias("r"))
        a, b, c = (F.get("p", F.lit(i)) for i in range(3))
        three = F.array(s(F.concat(a, b), c), s(F.concat(b, a), c), s(F.concat(a, c), b), s(F.concat(c, a), b), s(F.concat(b, c), a), s(F.concat(c, b), a))
        more = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: s(F.array_join(F.slice("p", F.lit(1), i), ""), F.array_join(F.slice("p", i + 1, F.size("p")), "")))
        tried = p.select("canon", "domain", F.posexplode(F.when(F.size("p") == 3, three).otherwise(more)).alias("ord", "t")).where((F.length("t.l") >= 2) & (F.length("t.r") >= 2))
        n = A.match_local
        keys = F.array(F.struct(F.lit(0).alias("o"), pair_key(n(F.col("t.l")), n(F.col("t.r"))).alias("key")), F.struct(F.lit(1).alias("o"), pair_key(F.col("t.l"), F.col("t.r")).alias("key")))
        rows = tried.select("canon", "domain", "ord", F.explode(keys).alias("k")).select("canon", "domain", "ord", "k.o", "k.key")
        hit = rows.join(self.two_part(), ["domain", "key"]).where("target <> canon")
        return hit.groupBy("canon").agg(F.min_by("target", F.struct("ord", "o")).alias("dst")).select(F.col("canon").alias("src"), "dst")

    def stripped_prefixes(self) -> DataFrame:
        """A part that ends (or else begins) with a known longer-than-two part of its domain, and with it makes a known pair."""
        c = self.canons()
        two = self.two_part()
        known = c.where(F.size(parts(F.col("local"))) == 2).select("domain", F.explode(parts(F.col("local"))).alias("known")).where(F.length("known") >= 3).distinct()
        p = c.select("canon", "domain", F.filter(F.split("local", r"[._\-]"), lambda x: F.length(x) > 0).alias("p")).where(F.size("p") >= 2)
        one = p.select("canon", "domain", "p", F.posexplode("p").alias("i", "part")).where(F.length("part") > 3)
        cuts = F.transform(F.sequence(F.lit(3), F.length("part") - 1), lambda k: F.array(F.struct(F.lit(0).alias("side"), F.substring("part", F.length("part") - k + 1, k).alias("known")), F.struct(F.lit(1).alias("side"), F.substring(F.col("part"), F.lit(1), k).alias("known"))))
        rows = one.select("canon", "domain", "p", "i", F.explode(F.flatten(cuts)).alias("c")).select("canon", "domain", "p", "i", "c.side", "c.known")
        rows = multiplied(rows).join(known, ["domain", "known"])
        left = rows.withColumn("q", F.filter(F.transform("p", lambda x, j: F.when(j == F.col("i"), F.col("known")).otherwise(x)), lambda x: F.length(x) > 1)).where(F.size("q") == 2)
        hit = left.withColumn("key", pair_key(F.get("q", F.lit(0)), F.get("q", F.lit(1)))).join(two, ["domain", "key"]).where("target <> canon")
        return hit.groupBy("canon").agg(F.min_by("target", F.struct("i", "side", -F.length("known"), "known")).alias("dst")).select(F.col("canon").alias("src"), "dst")

    def fuzzy_candidates(self) -> DataFrame:
        """Pairs of one domain within the edit bound: two, or a fifth of the shorter local part; the first is the shorter, then the lesser.

        By pigeonhole, without comparing a domain's addresses with each other: the shorter local part is cut evenly into one piece more than its bound, so one piece stands
        whole in the longer one, shifted by no more than the edits before or behind it allow. Pieces and the substrings that may equal them meet in a
        hash join; a domain of a tenth of all nodes costs no more than its share.
        """
        c = self._per_node(self.named().withColumn("n", F.length("local")).where("n >= 2 AND domain <> ''"))
        bound = "greatest(2, n div 5)"
        # Piece i of k = bound + 1 begins at i * (n div k) plus one for every longer piece before it; the longer pieces come last.
        start = "i * (n div (t + 1)) + greatest(0, i - (t + 1 - n % (t + 1)))"
        size = "(n div (t + 1)) + if(i >= t + 1 - n % (t + 1), 1, 0)"
        key = F.xxhash64("domain", F.col("n").cast("int"), F.col("i").cast("int"), "piece").alias("key")
        a = c.select("canon", "domain", "local", "n", F.expr(bound).alias("t")).select("*", F.explode(F.expr("sequence(0, t)")).alias("i"))
        a = a.withColumn("piece", F.expr(f"substring(local, {start} + 1, {size})")).select(key, F.col("canon").alias("canon_a"))
        b = c.select("canon", "domain", "local", F.col("n").alias("m")).select("*", F.explode(F.expr("sequence(greatest(2, m - greatest(2, m div 5)), m)")).alias("n"))
        b = b.withColumn("t", F.expr(bound)).where("m - n <= t").select("*", F.explode(F.expr("sequence(0, t)")).alias("i"))
        b = b.withColumn("s", F.expr(start)).withColumn("z", F.expr(size))
        b = b.withColumn("lo", F.expr("greatest(0, s - i, s + (m - n) - (t - i))")).withColumn("hi", F.expr("least(m - z, s + i, s + (m - n) + (t - i))")).where("lo <= hi")
        b = b.select("canon", "domain", "local", "n", "i", "z", F.explode(F.expr("sequence(lo, hi)")).alias("p")).withColumn("piece", F.expr("substring(local, p + 1, z)")).select(key, F.col("canon").alias("canon_b"))
        pairs = multiplied(a).join(b, "key").where("canon_a <> canon_b").select("canon_a", "canon_b").distinct()
        for side in "ab":
            pairs = pairs.join(c.select(*[F.col(x).alias(f"{x}_{side}") for x in ("canon", "domain", "local", "total", "name", "n")]), f"canon_{side}")
        near = (F.col("domain_a") == F.col("domain_b")) & (F.struct("n_a", "local_a", "canon_a") < F.struct("n_b", "local_b", "canon_b"))
        pairs = pairs.where(near).withColumn("bound", F.expr("greatest(2, n_a div 5)")).where("n_b - n_a <= bound")
        return pairs.withColumn("dist", F.levenshtein("local_a", "local_b")).where("dist <= bound")

    def fuzzy(self) -> DataFrame:
        """Components of the fuzzy pairs, each led by its member of most traffic. Names speak at the bound, and against merging two busy addresses of like traffic."""
        c = self.scratch.save(self.fuzzy_candidates())
        has = lambda x: F.col(x).isNotNull() & (F.col(x) != "")
        both = has("name_a") & has("name_b")
        busy = (F.least("total_a", "total_b") > BUSY) & (F.greatest("total_a", "total_b") / F.least("total_a", "total_b") < BUSY_RATIO)
        unsure = both & ((F.col("dist") == F.col("bound")) | busy)
        tokens = lambda x: F.array_distinct(F.filter(F.split(F.lower(F.col(x)), r"\s+"), lambda w: F.length(w) > 0))
        share = F.size(F.array_intersect(tokens("name_a"), tokens("name_b"))) / F.greatest(F.size(F.array_union(tokens("name_a"), tokens("name_b"))), F.lit(1))
        common = F.arrays_overlap(parts(F.col("local_a"), 3), parts(F.col("local_b"), 3))
        plain = c.where(~unsure & ~(busy & ~both)).select("canon_a", "canon_b")
        hard = c.where(unsure).withColumn("jw", jaro_winkler_udf(F.lower("name_a"), F.lower("name_b")))
        gate = (F.col("dist") < F.col("bound")) | (F.col("jw") >= NAME_SIMILARITY) | (share >= TOKEN_SHARE) | common
        passed = hard.where(gate & (~busy | (F.col("jw") >= SAME_NAME))).select("canon_a", "canon_b")
        return self._led(plain.unionByName(passed))

    def _led(self, pairs: DataFrame) -> DataFrame:
        """Merges of the components of ``canon_a, canon_b`` into their members of most traffic, then greatest address."""
        comp = components(pairs, "canon_a", "canon_b").join(self.canons().select(F.col("canon").alias("node"), "total"), "node")
        lead = comp.groupBy("component").agg(F.max(F.struct("total", "node")).alias("l")).select("component", F.col("l.node").alias("dst"))
        return comp.join(lead, "component").where("node <> dst").select(F.col("node").alias("src"), "dst")

    def single_to_full(self) -> DataFrame:
        """A local part of one part that is a part of one fuller address of its domain, or of one with five times the traffic of the next."""
        c = self.canons().withColumn("p", parts(F.col("local")))
        one = c.where(F.size("p") <= 1).select("domain", F.col("canon").alias("src"), F.col("local").alias("part"))
        full = c.where(F.size("p") > 1).select("domain", "canon", "total", F.explode(F.array_distinct("p")).alias("part"))
        # Only the two busiest of a part count: max and the next, as one aggregate of two rows.
        top = full.groupBy("domain", "part").agg(F.max(F.struct("total", F.expr("canon"))).alias("t"), F.count(F.lit(1)).alias("n"))
        rest = multiplied(full).join(top, ["domain", "part"]).where("canon <> t.canon").groupBy("domain", "part").agg(F.max("total").alias("second"))
        fit = top.join(rest, ["domain", "part"], "left").where((F.col("n") == 1) | ((F.col("t.total") > 0) & ((F.col("second") == 0) | (F.col("t.total") / F.greatest(F.lit(1), "second") >= TIMES))))
        return one.join(fit, ["domain", "part"]).select("src", F.col("t.canon").alias("dst"))

    def concatenated(self) -> DataFrame:
        """A local part of six characters or more that splits into the parts of exactly one known pair of its domain."""
        c = self.canons().where((F.size(parts(F.col("local"))) <= 1) & (F.length("local") >= 6))
        cut = c.select("canon", "domain", "local", F.explode(F.sequence(F.lit(2), F.length("local") - 2)).alias("i"))
        key = pair_key(F.expr("substring(local, 1, i)"), F.expr("substring(local, i + 1)"))
        hit = cut.withColumn("key", key).join(self.two_part(), ["domain", "key"]).where("target <> canon")
        return hit.groupBy("canon").agg(F.min("target").alias("dst"), F.countDistinct("target").alias("n")).where("n = 1").select(F.col("canon").alias("src"), "dst")

    def same_name(self) -> DataFrame:
        """Equal names in one domain; equal local parts in like domains; equal names with like local parts."""
        c = self._per_node(self.named().withColumn("key", name_key("name")).withColumn("generic", F.col("local").isin(*self.generic)).withColumn("given", F.lower("local").isin(*self.first_names)))
        lead = c.where("key IS NOT NULL").groupBy("domain", "key").agg(F.min_by("canon", F.struct(F.negative("total"), "canon")).alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1")
        s1 = self.scratch.save(c.join(lead, ["domain", "key"]).where("canon <> dst").select(F.col("canon").alias("src"), "dst"))
        free = c.join(s1.select(F.col("src").alias("canon")), "canon", "left_anti")
        two = lambda d, on: d.select(*on, *[F.col(x).alias(f"{x}_a") for x in ("canon", "domain", "local", "generic", "given")]).join(d.select(*on, *[F.col(x).alias(f"{x}_b") for x in ("canon", "domain", "local", "generic", "given")]), on).where("canon_a < canon_b")
        like = F.levenshtein("domain_a", "domain_b") <= F.greatest(F.lit(3), F.expr("greatest(length(domain_a), length(domain_b)) div 3"))
        b = free.where("NOT generic AND NOT given AND length(local) > 3").withColumn("block", F.col("local"))
        s1b = self.scratch.save(self._led(two(b, ["block"]).where((F.col("domain_a") != F.col("domain_b")) & like).select("canon_a", "canon_b")))
        free = free.join(s1b.select(F.col("src").alias("canon")), "canon", "left_anti").where("name IS NOT NULL AND name <> ''")
        any_key = F.array_join(F.array_sort(F.filter(F.split(F.lower("name"), r"\s+"), lambda x: F.length(x) > 0)), " ")
        d = free.withColumn("any_key", any_key).withColumn("block", F.col("local")).withColumn("close", F.col("generic") | F.col("given") | (F.length("local") <= 4))
        # Where the domain does not matter, equal local parts and names are linked through their least address: the same closure without all pairs.
        s2 = self._star(d.where("NOT close"), ["block", "any_key"]).unionByName(two(d.where("close"), ["block", "any_key"]).where(like).select("canon_a", "canon_b"))
        s3 = self._alike(d.where("key IS NOT NULL AND length(local) >= 3"), like)
        return s1.unionByName(s1b).unionByName(self._led(s2.unionByName(s3)))

    def _star(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """Pairs of every address of a group with the group's least one."""
        least = rows.groupBy(*by).agg(F.min("canon").alias("canon_a"), F.count(F.lit(1)).alias("many")).where("many > 1").select(*by, "canon_a")
        return rows.join(least, by).where("canon <> canon_a").select("canon_a", F.col("canon").alias("canon_b"))

    def _alike(self, rows: DataFrame, like: Column) -> DataFrame:
        """Pairs of one name whose local parts are alike as a whole or part by part; generic, given and short ones need like domains as well.

        The others are compared as distinct local parts: of each name and local part the least address stands for all, which equal local parts link to it anyway. Which of two
        parts' sizes bounds their distance depends on the order of the addresses, so both orders that some two addresses have are tried.
        """
        full = F.levenshtein("local_a", "local_b") <= F.greatest(F.lit(2), F.expr("least(length(local_a), length(local_b)) div 4"))
        size = F.aggregate("pa", F.lit(0), lambda s, x: s + F.length(x))

        def near(pairs: DataFrame) -> DataFrame:
            e = pairs.withColumn("full", full).withColumn("pa", parts(F.col("local_a"))).withColumn("pb", parts(F.col("local_b")))
            partly = e.where(~F.col("full") & (F.size("pa") == F.size("pb")) & (F.size("pa") >= 2)).withColumn("pd", parts_distance_udf("pa", "pb")).where(F.col("pd") <= F.greatest(F.lit(2), F.floor(size / 4)))
            return e.where("full").select("canon_a", "canon_b").unionByName(partly.select("canon_a", "canon_b"))

        plain = rows.where("NOT close").groupBy("key", "local").agg(F.min("canon").alias("canon"), F.max("canon").alias("last"))
        l, r = (plain.select("key", *[F.col(x).alias(f"{x}_{s}") for x in ("local", "canon", "last")]) for s in "ab")
        apart = near(l.join(r, "key").where("local_a <> local_b AND canon_a < last_b").select("canon_a", "canon_b", "local_a", "local_b"))
        some = ["key", *[f"{x}_a" for x in ("canon", "domain", "local")], *[f"{x}_b" for x in ("canon", "domain", "local")]]
        side = lambda d, s: d.select("key", *[F.col(x).alias(f"{x}_{s}") for x in ("canon", "domain", "local")])
        short, long = rows.where("close"), rows.where("NOT close")
        mixed = side(short, "a").join(side(rows, "b"), "key").select(*some).unionByName(side(long, "a").join(side(short, "b"), "key").select(*some))
        return self._star(rows.where("NOT close"), ["key", "local"]).unionByName(apart).unionByName(near(mixed.where("canon_a < canon_b").where(like)))

    def run(self, fuzzy: bool = True) -> Resolution:
        self.structural()
        self.domain()
        self.local_characters()
        self.merge("split", self.split_locals())
        self.merge("prefix", self.stripped_prefixes())
        if fuzzy:
            self.merge("fuzzy", self.fuzzy())
        self.merge("single", self.single_to_full())
        self.merge("concat", self.concatenated())
        self.merge("same_name", self.same_name())
        return self

    def layer_stats(self) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame(self.changes, "layer string, changes long")
