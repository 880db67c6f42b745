"""Problem 3: consolidating pairwise matches into groups by tree contraction.

The graph is reduced before it is solved. Each round *rakes* the vertices of degree one into their neighbour and
*compresses* every maximal chain of degree-two vertices into one edge; the two ends of a chain are found by list ranking
(pointer doubling over directed arcs), so a chain of length L takes log2(L) joins and not L rounds. What is left has
minimum degree three. That core is solved by hooking every vertex to its neighbour of least random rank, pointer jumping
and contraction. The removed vertices form a forest over the roots; its labels are restored by pointer jumping.

All joins merge: sides shrink together from round to round, and a broadcast per join and round would fill the driver.
Every round ends in a table in the shared checkpoint folder. Nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistola.session import Scratch

_ARC = "v long, f long, t long, tf long, hops long, m long"


def _degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("v"))
    return ends.groupBy("v").agg(F.count(F.lit(1)).alias("deg"))


def _with_degrees(edges: DataFrame) -> DataFrame:
    deg = _degrees(edges)
    return edges.join(deg.select(F.col("v").alias("a"), F.col("deg").alias("da")).hint("merge"), "a").join(deg.select(F.col("v").alias("b"), F.col("deg").alias("db")).hint("merge"), "b")


def _rake(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges without leaves, forest rows of the leaves), both views of one stored table. An isolated edge hangs its larger vertex on its smaller one."""
    d = scratch.save(_with_degrees(edges))
    leaf = F.when((F.col("da") == 1) & (F.col("db") == 1), F.greatest("a", "b")).when(F.col("da") == 1, F.col("a")).when(F.col("db") == 1, F.col("b"))
    cut = d.where((F.col("da") == 1) | (F.col("db") == 1)).select(leaf.alias("v"), (F.col("a") + F.col("b") - leaf).alias("p"))
    return d.where((F.col("da") > 1) & (F.col("db") > 1)).select("a", "b"), cut


def _rank_chains(scratch: Scratch, arcs: DataFrame) -> DataFrame:
    """List ranking of arcs (v entered from f, leaving to t): afterwards t is the chain's end in that direction and hops
    the distance to it; on pure cycles, which have no end, t is null and m is the least vertex of the cycle."""
    cur, active, cycles = scratch.save(arcs), None, False
    held = cur
    while True:
        nxt = cur.select(F.col("v").alias("t"), F.col("f").alias("tf"), F.col("t").alias("t2"), F.col("tf").alias("tf2"), F.col("hops").alias("h2"), F.col("m").alias("m2"))
        step = cur.join(nxt.hint("merge"), ["t", "tf"], "left").select(
            "v",
            "f",
            F.coalesce("t2", "t").alias("t"),
            F.coalesce("tf2", "tf").alias("tf"),
            (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"),
            F.least("m", "m2").alias("m"),
            F.col("t2").isNotNull().alias("moved"),
            (F.col("m2") < F.col("m")).alias("lower"),
        )
        new = scratch.save(step)
        moved, lower = new.agg(F.count_if("moved"), F.count_if("lower")).first()
        scratch.drop(held)
        # An open chain has an arc at every distance from its end, so some arc ends in each step; if none did, only cycles move.
        cycles = cycles or (active is not None and moved == active)
        if moved == 0 or (cycles and lower == 0):
            return new.select("v", "f", F.when(~F.col("moved"), F.col("t")).alias("t"), "hops", "m")
        active = moved
        cur, held = new.select("v", "f", "t", "tf", "hops", "m"), new


def _compress(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(edges between chain ends, forest rows of the chain vertices); None if no vertex has degree two."""
    d = scratch.save(_with_degrees(edges))
    if d.where((F.col("da") == 2) | (F.col("db") == 2)).isEmpty():
        return None
    both = d.select(F.col("a").alias("v"), F.col("b").alias("w"), F.col("da").alias("deg")).unionByName(d.select(F.col("b").alias("v"), F.col("a").alias("w"), F.col("db").alias("deg")))
    pairs = both.where("deg = 2").groupBy("v").agg(F.min("w").alias("x"), F.max("w").alias("y"))
    one = pairs.select("v", F.col("x").alias("f"), F.col("y").alias("t"))
    two = pairs.select("v", F.col("y").alias("f"), F.col("x").alias("t"))
    arcs = one.unionByName(two).select("v", "f", "t", F.col("v").alias("tf"), F.lit(1).cast("long").alias("hops"), F.col("v").alias("m"))
    ranked = _rank_chains(scratch, arcs)
    ends = ranked.groupBy("v").agg(F.min("t").alias("e1"), F.max("t").alias("e2"), F.min("hops").alias("near"), F.min("m").alias("m"))
    ends = scratch.save(ends)
    forest = ends.select("v", F.coalesce("e1", "m").alias("p")).where("v <> p")
    bridges = ends.where("e1 < e2 AND near = 1").select(F.col("e1").alias("a"), F.col("e2").alias("b"))
    # An end may be a fresh leaf: its bridge is raked in the next round. Cycles have no end and are finished here.
    kept = d.where((F.col("da") != 2) & (F.col("db") != 2)).select("a", "b")
    return kept.unionByName(bridges).distinct(), forest


def _contract(scratch: Scratch, edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """One round on the core: hook each vertex to the neighbour of least random rank, jump to the roots, contract."""
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("r"), F.col(c).alias("id"))
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    hook = both.groupBy("v").agg(F.min(rank("w")).alias("n")).withColumn("own", rank("v"))
    forest = _jump(scratch, hook.select("v", F.when(F.col("n") < F.col("own"), F.col("n.id")).otherwise(F.col("v")).alias("p")))
    ra, rb = (forest.select(F.col("v").alias(x), F.col("p").alias(f"r{x}")) for x in "ab")
    ends = edges.join(ra.hint("merge"), "a").join(rb.hint("merge"), "b").where("ra <> rb")
    return ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), forest.where("v <> p")


def _jump(scratch: Scratch, forest: DataFrame) -> DataFrame:
    """Pointer jumping: afterwards p is the root of v. Roots may lack a row."""
    cur = held = scratch.save(forest)
    while True:
        up = cur.select(F.col("v").alias("p"), F.col("p").alias("q"))
        new = scratch.save(cur.join(up.hint("merge"), "p", "left").select("v", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") != F.col("p")).alias("moved")))
        more = not new.where("moved").isEmpty()
        scratch.drop(held)
        if not more:
            return new.select("v", "p")
        cur, held = new.select("v", "p"), new


def connected_groups(links: DataFrame, src: str = "src", dst: str = "dst", node: str = "id", group: str = "group_id") -> DataFrame:
    """``(node, group)`` for every id that a link ties to another one; ``group`` is the smallest id of its component.

    Null ids and self links say nothing; repeated and turned links count once; an empty input gives an empty result.
    Other columns of ``links`` are ignored, whatever their names. Work per round shrinks with the reduced graph; hot
    hubs cost nothing special, since degrees and minima are partial aggregates and hub joins have a unique build side.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    pairs = links.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s IS NOT NULL AND d IS NOT NULL AND s <> d")
    pairs = scratch.save(pairs.select(F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d")).distinct())
    ids = scratch.save(pairs.select(F.explode(F.array("s", "d")).alias("id")).distinct().withColumn("v", F.monotonically_increasing_id()))
    a, b = (ids.select(F.col("id").alias(x), F.col("v").alias(y)) for x, y in (("s", "a"), ("d", "b")))
    edges = scratch.save(pairs.join(a.hint("merge"), "s").join(b.hint("merge"), "d").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    scratch.drop(pairs)
    forest: list[DataFrame] = []
    seed = 0
    while not edges.isEmpty():
        left, cut = _rake(scratch, edges)
        forest.append(cut)
        if (done := _compress(scratch, left)) is not None:
            forest.append(done[1])
            left = scratch.save(done[0])
        elif cut.isEmpty():  # neither leaves nor chains, so minimum degree three: the core
            seed += 1
            core, roots = _contract(scratch, left, seed)
            forest.append(roots)
            left = scratch.save(core)
        edges = left
    label = ids.select("id", "v")
    if forest:
        up = forest[0]
        for f in forest[1:]:
            up = up.unionByName(f)
        roots = _jump(scratch, up)
        label = ids.join(roots.hint("merge"), "v", "left").select("id", F.coalesce("p", "v").alias("root"))
        least = label.groupBy("root").agg(F.min("id").alias("least"))
        return label.join(least.hint("merge"), "root").select(F.col("id").alias(node), F.col("least").alias(group))
    return label.select(F.col("id").alias(node), F.col("id").alias(group))


def consolidate_matches(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, group_id)``: groups over the rows of ``matches`` both of whose ids stand in ``nodes``."""
    known = nodes.select(F.col("id")).where("id IS NOT NULL").distinct()
    m = matches.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
    m = m.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    return connected_groups(m)
