"""Problem 1: variant spellings of the names of persons and organisations.

1. Names and addresses are read into parts; both give a spelling of the surname (or an organisation's head word).
2. *Suffix blocking.* Every distinct spelling is indexed under each of its suffixes of ``MIN_SUFFIX`` letters or more, and under those
   of the spelling read backwards, for damage near its end. A suffix of more than
   ``MAX_BLOCK`` spellings is refined with first initial and domain; what is too common even then is left to the longer suffixes of
   the same spellings, which are indexed too.
3. Pairs within a block are compared by longest-common-subsequence ratio, and each spelling leans on its most frequent close
   neighbour; the chains this makes are followed to their ends. Damaged domains lean on known ones by the same ratio.
   All joins merge: their sides are of one size, and many broadcasts of middling tables would only fill the driver.
4. Under one surname the first names, initials, middle initials and domains, counted per kind and not per node, decide who is who. A kind sees the
   counts of its surname and of its surname at its domain, which are aggregated and joined to it; kinds are never brought together in a task.

First names need not be listed: a word that stands as first name before ``LEARNED`` surnames or more counts as one, unless a
listed one under the same surname is close to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epistola.llm.personname import FULL, SHORT_FORMS, lcs, ratio, read_local, read_name
from epistola.session import Scratch

MIN_SUFFIX, MAX_BLOCK = 5, 64
#: Least ratio of a spelling to a neighbour several times as frequent, and to any more frequent one.
CLOSE, CLOSER, SEVERAL = 0.78, 0.86, 3.0
#: Least ratio of a damaged domain to a known one, and of a damaged first name to one of its surname.
PLACE, FIRST = 0.88, 0.72
#: Before so many different surnames must an unlisted word stand to count as a first name.
LEARNED = 3
AMBIGUOUS = {"ted": ("theodore", "edward"), "pat": ("patricia",), "rob": ("robert",)}

_READ = "id string, org string, a string, b string, first string, raw string, exact boolean, initial string, middle string, host string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.bool_() if n == "exact" else pa.string() for n in names]
    for b in batches:
        cols = list(zip(*(_row(*r) for r in zip(*(b.column(k).to_pylist() for k in range(3)))))) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def _row(id_: str, name: str | None, domain: str | None) -> tuple:
    n = read_name(name)
    local, _, host = id_.partition("@")
    p = read_local(local, n)
    org = None if not n and not p else (n.org if n and n.org is not None else p.org if p and p.org is not None and not n else None)
    both = [x for x in (n, p) if x]
    firsts = sorted((x for x in both if x.first), key=lambda x: (not x.exact, x.raw in AMBIGUOUS, x is p))
    f = firsts[0] if firsts else None
    initial = f.first[0] if f else next((x.initial for x in both if x.initial), None)
    middle = next((x.middle for x in both if x.middle and x.middle != ""), None)
    raw = f.raw if f else n.raw if n and n.org is None else None
    return (id_, org, n.last if n else None, p.last if p else None, f.first if f else None, raw, bool(f and f.exact and f.raw not in AMBIGUOUS), initial, middle, domain or host)


def squeezed(c: str):
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def places(hosts: DataFrame, domains: DataFrame | None) -> DataFrame:
    """``host, dom``: the known domain that a damaged one stands for, or its own letters and figures. Close ones are found by q-grams: of a known domain
    so many of the rarest that a domain of the least ratio shares one of them."""
    h = hosts.select("host").distinct().withColumn("s", squeezed("host"))
    if domains is None:
        return h.select("host", F.col("s").alias("dom"))
    known = domains.select("domain", squeezed("domain").alias("k")).where("domain IS NOT NULL AND k <> ''").groupBy("k").agg(F.min("domain").alias("domain"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(3))))
    open_ = h.select("s").distinct().join(known.select(F.col("k").alias("s")), "s", "left_anti")
    index = known.select("k", F.explode(grams("k")).alias("g"))
    rarest = Window.partitionBy("k").orderBy("df", "g")
    index = index.join(index.groupBy("g").agg(F.count(F.lit(1)).alias("df")), "g").withColumn("at", F.row_number().over(rarest))
    # With a ratio r, s has at most k(2 - r)/r letters, and (1 - r)(s + k) letters of both are not shared; each spoils three q-grams.
    index = index.where(F.col("at") <= 3 * F.floor(F.length("k") * (1 - PLACE) * 2 / PLACE) + 1)
    pairs = open_.select("s", F.explode(grams("s")).alias("g")).join(index.hint("merge"), "g")
    pairs = pairs.where(2 * F.least(F.length("s"), F.length("k")) >= PLACE * (F.length("s") + F.length("k"))).select(F.col("s").alias("x"), F.col("k").alias("y")).distinct()
    best = pairs.mapInArrow(_ratio_rows, "x string, y string, r double").where(F.col("r") >= PLACE).groupBy("x").agg(F.max(F.struct("r", "y")).alias("b"))
    found = best.select(F.col("x").alias("s"), F.col("b.y").alias("k")).unionByName(known.select(F.col("k").alias("s"), "k")).join(known, "k").select("s", "domain")
    return h.join(found.hint("merge"), "s", "left").select("host", F.coalesce("domain", "s").alias("dom"))


def _ratio_rows(batches):
    for b in batches:
        x, y = b.column(0).to_pylist(), b.column(1).to_pylist()
        r = [2 * lcs(p, q) / (len(p) + len(q)) for p, q in zip(x, y)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(r, pa.float64())], names=["x", "y", "r"])


def suffix_pairs(spellings: DataFrame) -> DataFrame:
    """Pairs ``(x, y)`` of distinct spellings that share a block; ``spellings``: ``form, initial, dom``."""
    ways = spellings.select("form").distinct().select("form", F.explode(F.array(F.col("form"), F.concat(F.reverse("form"), F.lit("<")))).alias("s"))
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("s") - MIN_SUFFIX + 1, F.lit(1)))).alias("i")
    rows = ways.select("form", "s", at).select("form", F.expr("substring(s, i)").alias("suffix"))
    sizes = rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = rows.join(sizes.hint("merge"), "suffix")
    plain = rows.where(F.col("size") <= MAX_BLOCK).select(F.col("suffix").alias("block"), "form")
    fine = rows.where(F.col("size") > MAX_BLOCK).select("suffix", "form").join(spellings.select("form", "initial", "dom").hint("merge"), "form")
    fine = fine.select(F.concat_ws("|", "suffix", F.coalesce("initial", F.lit("")), "dom").alias("block"), "form").distinct()
    few = fine.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > 1) & (F.col("size") <= MAX_BLOCK))
    blocks = plain.unionByName(fine.join(few.select("block").hint("merge"), "block"))
    pairs = blocks.select("block", F.col("form").alias("x")).join(blocks.select("block", F.col("form").alias("y")).hint("merge"), "block")
    # No common subsequence is longer than the shorter of the two.
    able = 2 * F.least(F.length("x"), F.length("y")) >= CLOSE * (F.length("x") + F.length("y"))
    return pairs.where((F.col("x") < F.col("y")) & able).select("x", "y").distinct()


def anchors(scratch: Scratch, read: DataFrame) -> DataFrame:
    """``form, anchor``: the spelling each surname spelling stands for."""
    forms = read.select(F.explode(F.array("a", "b")).alias("form"), "initial", "dom").where("form IS NOT NULL AND length(form) >= 3")
    forms = scratch.save(forms.groupBy("form", "initial", "dom").agg(F.count(F.lit(1)).alias("n")))
    count = scratch.save(forms.groupBy("form").agg(F.sum("n").alias("n")))
    close = suffix_pairs(forms).mapInArrow(_ratio_rows, "x string, y string, r double").where(F.col("r") >= CLOSE)
    both = close.select(F.col("x").alias("form"), F.col("y").alias("to"), "r").unionByName(close.select(F.col("y").alias("form"), F.col("x").alias("to"), "r"))
    both = both.join(count.withColumnRenamed("n", "own").hint("merge"), "form").join(count.select(F.col("form").alias("to"), F.col("n").alias("n")).hint("merge"), "to")
    higher = (F.col("n") > F.col("own")) | ((F.col("n") == F.col("own")) & (F.col("to") < F.col("form")))
    lean = both.where(higher & ((F.col("n") >= SEVERAL * F.col("own")) | (F.col("r") >= CLOSER)))
    best = lean.groupBy("form").agg(F.max(F.struct((F.col("n") >= SEVERAL * F.col("own")).alias("several"), "r", "n", "to")).alias("b")).select("form", F.col("b.to").alias("anchor"))
    chain = scratch.save(count.select("form").join(best.hint("merge"), "form", "left").select("form", F.coalesce("anchor", "form").alias("anchor")))
    while True:  # every step of a chain leads to a higher count or an earlier spelling, so chains end
        up = chain.select(F.col("form").alias("anchor"), F.col("anchor").alias("top"))
        step = scratch.save(chain.join(up.hint("merge"), "anchor").select("form", F.col("top").alias("anchor"), (F.col("top") != F.col("anchor")).alias("moved")))
        chain = step.select("form", "anchor")
        if step.where("moved").isEmpty():
            return chain.join(count.hint("merge"), "form")


_PARTS = ["anchor", "org", "first", "raw", "exact", "initial", "middle", "dom"]
_KIND = "anchor string, org string, first string, raw string, exact boolean, initial string, middle string, dom string, n long"


def _extra(batches):
    """A kind whose address runs something together with the surname: a first name, or an initial."""
    for b in batches:
        rows = b.to_pylist()
        for r in rows:
            if r["org"] is None and not r["first"] and not r["initial"] and r["raw"]:
                full = FULL.get(r["raw"])
                r |= {"first": full, "exact": bool(full) and r["raw"] not in AMBIGUOUS, "initial": full[0] if full else r["raw"] if len(r["raw"]) == 1 else None}
        yield pa.RecordBatch.from_pylist([{"was_" + k: v for k, v in w.items() if k in ("first", "exact", "initial")} | r for w, r in zip(b.to_pylist(), rows)], schema=_EXTRA)


_EXTRA = pa.schema([*[("was_" + k, t) for k, t in (("first", pa.string()), ("exact", pa.bool_()), ("initial", pa.string()))], *[(x.split()[0], {"boolean": pa.bool_(), "long": pa.int64()}.get(x.split()[1], pa.string())) for x in _KIND.split(", ")]])


def who(r: dict, firsts: dict[str, int], here: dict[str, int]) -> str:
    """Whose first name a person's kind stands for, by the first names of its surname and of its surname at its domain, with their counts. Without
    any the kind belongs to its domain."""
    if r["first"] and r["exact"]:
        close = [f for f in firsts if f in SHORT_FORMS and ratio(r["first"], f) >= FIRST] if r["first"] not in SHORT_FORMS else []
        return max(close, key=lambda f: (ratio(r["first"], f) + 0.1 * (f in here), firsts[f], f)) if close else r["first"]
    if r["first"] and r["raw"] in AMBIGUOUS:
        able = [f for f in AMBIGUOUS[r["raw"]] if f in firsts]
        return max(able, key=lambda f: (here.get(f, 0), firsts[f], f)) if able else r["first"]
    if r["first"]:
        raw = r["raw"] or r["first"]
        able = [f for f in firsts if ratio(raw, f) >= FIRST or FULL.get(raw) == f]
        return max(able, key=lambda f: (max(ratio(raw, f), ratio(raw.replace("o", "a"), f)) + 0.1 * (f in here), firsts[f], f)) if able else r["first"]
    able = [f for f in firsts if f[0] == r["initial"]] if r["initial"] else list(firsts)
    near = [f for f in able if f in here]
    pick = near if len(near) == 1 else able if len(able) == 1 else []
    return pick[0] if pick else f"{r['initial']}.@{r['dom']}" if r["initial"] else f"?@{r['dom']}"


def which(r: dict, kinds: dict[str, int], here: dict[str, int]) -> str:
    """The kind of organisation, by those of its head word and of its head word at its domain. A kind of one letter has lost a damaged word; it belongs to
    a whole one that holds it, else to the commonest."""
    kind = r["org"] or (next(iter(kinds)) if len(kinds) == 1 else next(iter(here)) if len(here) == 1 else "")
    whole = [k for k in kinds if len(k) > 1]
    return max(whole, key=lambda k: (kind in k, kinds[k], k)) if len(kind) < 2 and whole else kind


def _decide(batches):
    for b in batches:
        out = []
        for r in b.to_pylist():
            known, here = ({x["word"]: x["n"] for x in r.pop(k) or []} for k in ("known", "here"))
            if r["org"] == "role":
                out.append(f"role|{r['dom']}")
            else:
                out.append(which(r, known, here) if r["org"] is not None else who(r, known, here))
        keep = [b.column(k) for k in b.schema.names if k not in ("known", "here")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.string())], names=[*[k for k in b.schema.names if k not in ("known", "here")], "stands"])


def decide(scratch: Scratch, kinds: DataFrame) -> DataFrame:
    """The kinds with their ``entity``. What is listed per surname, first names and kinds of organisation, is bounded by the words there are for them."""
    more = [f"was_{k}" for k in ("first", "exact", "initial")]
    kinds = scratch.save(kinds.mapInArrow(_extra, "was_first string, was_exact boolean, was_initial string, " + _KIND))
    # An exact first name of a person, or the kind of an organisation.
    word = F.when(F.col("org").isNull(), F.when(F.col("exact"), F.col("first"))).when((F.col("org") != "role") & (F.col("org") != ""), F.col("org"))
    said = kinds.withColumn("is_org", F.col("org").isNotNull()).withColumn("word", word)
    counted = scratch.save(said.where("word IS NOT NULL").groupBy("anchor", "is_org", "dom", "word").agg(F.sum("n").alias("n")))
    listed = lambda by, rows, name: rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias(name))
    known = listed(["anchor", "is_org"], counted.groupBy("anchor", "is_org", "word").agg(F.sum("n").alias("n")), "known")
    here = listed(["anchor", "is_org", "dom"], counted, "here")
    seen_by = lambda c: said.where(c).select(*more, *_PARTS, "n", "is_org")
    # A person's kind with a listed first name in full speaks for itself.
    plain = ~F.col("is_org") & F.col("exact") & F.col("first").isin(*SHORT_FORMS)
    told = seen_by(plain).withColumn("stands", F.col("first"))
    asked = seen_by(~F.coalesce(plain, F.lit(False))).join(known.hint("merge"), ["anchor", "is_org"], "left").join(here.hint("merge"), ["anchor", "is_org", "dom"], "left").select(*more, *_PARTS, "n", "is_org", "known", "here")
    stands = scratch.save(told.unionByName(asked.mapInArrow(_decide, "was_first string, was_exact boolean, was_initial string, " + _KIND + ", is_org boolean, stands string")))
    people = stands.where("NOT is_org AND middle IS NOT NULL AND middle <> ''").groupBy("anchor", "stands", "dom", "middle").agg(F.count(F.lit(1)).alias("n"))
    many = people.groupBy("anchor", "stands").agg(F.countDistinct("middle").alias("middles")).where("middles > 1")
    homes = people.groupBy("anchor", "stands", "dom").agg(F.countDistinct("middle").alias("here"), F.min("middle").alias("home"))
    full = stands.join(many.hint("merge"), ["anchor", "stands"], "left").join(homes.hint("merge"), ["anchor", "stands", "dom"], "left")
    own = F.when(F.coalesce("middle", F.lit("")) != "", F.col("middle")).when(F.col("here") == 1, F.col("home")).otherwise(F.concat(F.lit("@"), "dom"))
    middle = F.when(F.col("middles") > 1, own).otherwise("")
    entity = F.when(F.col("is_org"), F.concat_ws("|", F.lit("o"), "anchor", "stands")).otherwise(F.concat_ws("|", F.lit("p"), "anchor", "stands", middle))
    was = [F.col(f"was_{k}").alias(k) if k in ("first", "exact", "initial") else F.col(k) for k in _PARTS]
    return full.select(*was, entity.alias("entity"))


def name_entities(nodes: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """``(id, entity)`` for every node whose name or address gives a surname or an organisation's head word.

    ``domains``: the known mail domains; without it damaged domains count as their own. Null ids are
    left out; a null name leaves the address to speak alone; of a repeated id the row with the greatest name and domain counts; extra columns are ignored.
    """
    scratch = Scratch(nodes.sparkSession, "names")
    d = nodes.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("name", "domain")).alias("r")).select("id", "r.name", "r.domain")
    read = scratch.save(d.mapInArrow(_read, _READ))
    # An unlisted word before several surnames is a first name.
    guess = (F.col("first").isNull()) & F.col("raw").isNotNull() & (F.length("raw") >= 3) & F.col("org").isNull()
    learned = read.where(guess).groupBy("raw").agg(F.countDistinct(F.coalesce("b", "a")).alias("k")).where(F.col("k") >= LEARNED).select("raw", F.lit(True).alias("learned"))
    read = read.join(learned, "raw", "left").join(places(read, domains).hint("merge"), "host", "left")
    taken = guess & F.coalesce("learned", F.lit(False))
    read = read.select("id", "org", "a", "b", F.when(taken, F.col("raw")).otherwise(F.col("first")).alias("first"), F.when(guess & ~taken, None).otherwise(F.col("raw")).alias("raw"), (F.col("exact") | taken).alias("exact"), "initial", "middle", "dom")
    read = scratch.save(read)
    anchor = scratch.save(anchors(scratch, read))
    a = anchor.select(F.col("form").alias("a"), F.col("anchor").alias("aa"), F.col("n").alias("na"))
    b = anchor.select(F.col("form").alias("b"), F.col("anchor").alias("ab"), F.col("n").alias("nb"))
    top = anchor.groupBy("anchor").agg(F.sum("n").alias("total"))
    both = read.join(a.hint("merge"), "a", "left").join(b.hint("merge"), "b", "left")
    both = both.join(top.select(F.col("anchor").alias("aa"), F.col("total").alias("ta")).hint("merge"), "aa", "left").join(top.select(F.col("anchor").alias("ab"), F.col("total").alias("tb")).hint("merge"), "ab", "left")
    placed = both.withColumn("anchor", F.when(F.coalesce("tb", F.lit(0)) > F.coalesce("ta", F.lit(0)), F.col("ab")).otherwise(F.col("aa"))).where("anchor IS NOT NULL")
    # An address without a name beside it may run a first name or an initial together with the surname.
    extra = F.when(F.col("ab") == F.col("b"), None).when(F.endswith("b", "ab"), F.expr("substring(b, 1, length(b) - length(ab))")).when(F.startswith("b", "ab"), F.expr("substring(b, length(ab) + 1)"))
    placed = placed.withColumn("raw", F.when(F.col("first").isNull() & F.col("initial").isNull() & F.col("org").isNull(), extra).otherwise(F.col("raw")))
    placed = scratch.save(placed.select("id", *_PARTS))
    kinds = placed.groupBy(*_PARTS).agg(F.count(F.lit(1)).alias("n"))
    decided = decide(scratch, kinds)
    cond = F.col("l.anchor") == F.col("r.anchor")
    for c in _PARTS[1:]:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return scratch.save(placed.alias("l").join(decided.alias("r").hint("merge"), cond).select("l.id", "r.entity"))


def name_groups(nodes: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """``(id, entity, same)``: every node's group, named by its smallest id, and how many ids the group has. Groups are not expanded into pairs."""
    e = name_entities(nodes, domains)
    return e.join(e.groupBy("entity").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("same")).hint("merge"), "entity").select("id", F.col("least").alias("entity"), "same")


def variant_pairs(nodes: DataFrame, domains: DataFrame | None = None, leave_out: DataFrame | None = None) -> DataFrame:
    """``(id_a, id_b)``: every pair of ids of one entity, smaller id first; ids in ``leave_out.orig_id`` on neither side."""
    e = name_entities(nodes, domains)
    if leave_out is not None:
        e = e.join(leave_out.select(F.col("orig_id").alias("id")).distinct(), "id", "left_anti")
    x, y = e.select("entity", F.col("id").alias("id_a")), e.select("entity", F.col("id").alias("id_b"))
    return x.join(y.hint("merge"), "entity").where("id_a < id_b").select("id_a", "id_b")
