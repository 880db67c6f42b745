import itertools
import random
import re

import numpy as np
import pytest

from epistola.functions.wordhash import grams, hash_words
from epistola.llm import components, leak, names, neardup, survivor
from epistola.llm.personname import lcs, ratio, read_local, read_name

NODES = "id string, name string, domain string, count long, years array<int>"


# --- words -----------------------------------------------------------------------------------------------------------------


def test_word_hashes_follow_the_definition():
    texts = [None, "", "Ein Wörtchen-Spiel 42", "a—b “c” İz", "x" * 5000 + " y", "😀".encode("utf-16", "surrogatepass").decode("utf-16") + " z_q"]
    h, ptr = hash_words(texts)
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    assert [len(w) for w in words] == list(np.diff(ptr))
    seen = {}
    for w, x in zip(itertools.chain(*words), h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert len(grams(h, 3)) == len(h) - 2 and len(grams(h[:2], 3)) == 0


# --- 3: groups ---------------------------------------------------------------------------------------------------------------


def union_find(pairs):
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


SHAPES = {
    "chain": [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)],
    "cycle": [(f"r{i:02d}", f"r{(i + 1) % 23:02d}") for i in range(23)],
    "star": [("hub", f"s{i}") for i in range(50)],
    "core": list(itertools.combinations([f"k{i}" for i in range(6)], 2)),
    "lollipop": [*itertools.combinations([f"l{i}" for i in range(5)], 2), *[(f"l4{'x' * i}", f"l4{'x' * (i + 1)}") for i in range(9)], ("l0", "l4xxx")],
    "theta": [("t0", "t1"), ("t1", "t2"), ("t0", "t3"), ("t3", "t2"), ("t0", "t4"), ("t4", "t2")],
    "pair": [("b", "a")],
}


@pytest.mark.parametrize("shape", [*SHAPES, "all", "random"])
def test_connected_groups(spark, shape):
    r = random.Random(5)
    pairs = [p for s in SHAPES.values() for p in s] if shape == "all" else [(f"n{r.randrange(80)}", f"n{r.randrange(80)}") for _ in range(90)] if shape == "random" else list(SHAPES[shape])
    want = union_find([p for p in pairs if p[0] != p[1]])
    df = spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs[:3]], ("self", "self"), (None, "z")], "src string, dst string").withColumnRenamed("x", "v")
    assert {x.id: x.group_id for x in components.connected_groups(df).collect()} == want


def test_groups_of_matches(spark):
    m = spark.createDataFrame([("a", "b", 0.1), ("b", "unknown", 0.9), ("c", "c", None), (None, None, None)], "src string, dst string, score double")
    n = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "id string")
    assert sorted(map(tuple, components.consolidate_matches(m, n).collect())) == [("a", "a"), ("b", "a")]
    assert components.consolidate_matches(m.limit(0), n).count() == 0


# --- 1: names ----------------------------------------------------------------------------------------------------------------


def test_parts_of_names():
    p = read_name("Stone-Hale, Ana B (EMA)")
    assert read_name("Dr. Kenneth Stonefield").last == "stonefield" and read_name("Stonefield, Ken").first == "kenneth"
    assert p.middle == "b" and read_name(None) is None and read_name("  ") is None
    assert read_name("Kenneth  Ston efield").last == "stonefield" and read_name("K. Stonefield").initial == "k"
    assert read_name("Stonefield Chemical Works").org == "cw" and read_name("The Stonefield CW").org == "cw"
    assert read_local("kstonefield", read_name("Ken Stonefield")).last == "stonefield"
    assert read_local("mailto-stonefield.kenneth").first == "kenneth"
    assert lcs("abcbdab", "bdcaba") == 4 and ratio("", "") == 0.0


def test_variant_pairs(spark):
    rows = [
        ("kenneth.stonefield@d.example.org", "Kenneth Stonefield", "d.example.org"),
        ("stonefleld.kenneth@d.example.org", "Stonefleld, Ken", "d.example.org"),
        ("kstonefield@d.example.org", "K. Stonefield", "d.example.org"),
        ("stonefield.kenneth@d.example.org", None, None),
        ("paula.stonefield@d.example.org", "Paula Stonefield", "d.example.org"),
        ("paul.stonefield@d.example.org", "Paul Stonefield", "d.example.org"),
        ("x", None, None),
        (None, "Kenneth Stonefield", "d.example.org"),
    ]
    n = spark.createDataFrame([(*r, "e", "a") for r in [*rows, rows[0]]], "id string, name string, domain string, entity string, anchor string")
    d = spark.createDataFrame([("d.example.org",), (None,)], "domain string")
    ken = sorted(r[0] for r in rows[:4])
    assert sorted(map(tuple, names.variant_pairs(n, d).collect())) == sorted(itertools.combinations(ken, 2))
    left = names.variant_pairs(n, None, spark.createDataFrame([(ken[0], "k")], "orig_id string, canon string"))
    assert sorted(map(tuple, left.collect())) == sorted(itertools.combinations(ken[1:], 2))
    assert names.variant_pairs(n.limit(0), d).count() == 0


def test_middle_initials_tell_persons_apart(spark):
    rows = [("ann@a.org", "Susan B. Stonefield", "a.org"), ("susan.stonefield@a.org", "Stonefield, Susan B", "a.org"), ("stonefield.susan@b.org", "Susan C. Stonefield", "b.org"), ("susan_stonefield@b.org", "Susan Stonefield", "b.org")]
    got = names.variant_pairs(spark.createDataFrame(rows, "id string, name string, domain string")).collect()
    assert sorted(map(tuple, got)) == [("ann@a.org", "susan.stonefield@a.org"), ("stonefield.susan@b.org", "susan_stonefield@b.org")]


def test_names_on_no_list(spark):
    assert (read_name("Priya Rao").last, read_name("Priya Rao").raw) == ("rao", "priya")
    assert read_name("Siddharth Iyer").last == read_name("Iyer, Siddharth").last == "iyer" and read_name("Van Dyke, Sigrun").raw == "sigrun"
    rows = []
    for k, last in enumerate("subramanian venkataraman krishnamurthy balakrishnan".split()):
        for first in ("priya", "siddharth"):
            rows += [(f"{first}.{last}@a.org", f"{first.title()} {last.title()}", "a.org"), (f"{last}.{first}@b.org", f"{last.title()}, {first.title()}", "b.org")]
    got = {tuple(r) for r in names.variant_pairs(spark.createDataFrame(rows, "id string, name string, domain string")).collect()}
    assert got == {tuple(sorted((rows[k][0], rows[k + 1][0]))) for k in range(0, len(rows), 2)}
    groups = names.name_groups(spark.createDataFrame(rows, "id string, name string, domain string")).collect()
    assert len(groups) == len(rows) and all(r.same == 2 and r.entity <= r.id for r in groups)


def test_damaged_domains_find_the_closest_known_one(spark):
    r = random.Random(3)
    known = ["".join(r.choice("abcdefghiklmnoprst") for _ in range(r.randrange(6, 14))) + ".example." + r.choice(["com", "org"]) for _ in range(60)]
    hosts = list(known[:5])
    for d in known:
        x = list(d)
        for _ in range(r.randrange(1, 4)):
            x[r.randrange(len(x))] = r.choice("abcdefghiklmnoprst1.")
        hosts.append("".join(x))
    hosts += ["", "x", None]
    sq = lambda d: re.sub(r"[\W_]", "", (d or "").lower())
    flat = {sq(d): d for d in known}
    best = lambda s: max(flat, key=lambda k: (ratio(s, k), k))
    want = {h: flat.get(sq(h)) or (flat[best(sq(h))] if ratio(sq(h), best(sq(h))) >= names.PLACE else sq(h)) for h in hosts}
    got = names.places(spark.createDataFrame([(h,) for h in hosts], "host string"), spark.createDataFrame([(d,) for d in [*known, None]], "domain string"))
    assert {x.host: x.dom for x in got.collect()} == want


def test_reviewed_groups_are_found(spark):
    d = "/root/testdata/sf0.01"
    e = names.name_entities(spark.read.parquet(f"{d}/nodes.parquet"), spark.read.parquet(f"{d}/domains.parquet"))
    a = spark.read.parquet(f"{d}/alias_map.parquet").selectExpr("orig_id AS id", "canon").distinct()
    both = e.join(a, "id").toPandas()
    pairs = lambda c: {p for _, g in both.groupby(c) for p in itertools.combinations(sorted(g.id), 2)}
    want, got = pairs("canon"), pairs("entity")
    assert len(want & got) / len(want) > 0.97 and len(want & got) / len(got) > 0.99


# --- 5: survivors --------------------------------------------------------------------------------------------------------------


def test_survivors(spark):
    n = spark.createDataFrame(
        [
            ("kenneth.stonefield@d.example.org", "K. Stonefield", "d.example.org", 5, [2001]),
            ("stonefield_kenneth@d.example.org", "STONEFIELD, KEN", "d.example.org", None, [2003, 2009]),
            ("kenneth.st0nefield@d.example.org", "Kenneth Stoneficld", "d.example.org", 7, None),
            ("stonefield.kenneth@d.example.orq", "Dr. Kenneth B. Stonefield", "d.example.orq", 1, [2015]),
            ("stonefield.kenneth@d.example.orq", "Dr. Kenneth B. Stonefield", "d.example.orq", 1, [2015]),
            (None, None, None, 3, None),
        ],
        NODES,
    ).selectExpr("*", "name AS canon", "1 AS total")
    ids = [r.id for r in n.collect() if r.id]
    a = spark.createDataFrame([*[(i, "k1") for i in ids], ("nobody@d.example.org", "k2"), (None, "k3"), (ids[0], None)], "orig_id string, canon string")
    d = spark.createDataFrame([("d.example.org", "D")], "domain string, org string")
    got = {r.canon: tuple(r)[1:] for r in survivor.survivors(a, n, d).collect()}
    assert got == {"k1": ("stonefield_kenneth@d.example.org", "Kenneth B. Stonefield", 13), "k2": (None, None, 0), "k3": (None, None, 0)}
    assert survivor.survivors(a.limit(0), n, d).count() == 0 and survivor.survivors(a, n.limit(0), d).count() == 3


def test_one_full_name_outranks_any_number_of_short_ones(spark):
    d = spark.createDataFrame([("d.example.org", "D")], "domain string, org string")
    for k in (3, 400):
        rows = [("robert.ashgrove@d.example.org", "Robert Ashgrove", "d.example.org", 1, [2001]), *[(f"bob.ashgrave.{i}@d.example.org", "Bob Ashgrave", "d.example.org", 1, [2002]) for i in range(k)]]
        n = spark.createDataFrame(rows, NODES)
        got = survivor.survivors(n.selectExpr("id AS orig_id", "'k' AS canon"), n, d).first()
        assert tuple(got) == ("k", "robert.ashgrove@d.example.org", "Robert Ashgrove", k + 1)


BUNDLES = "canon string, first string, last string, full boolean, trust long, n_clean long, everywhere long"


def test_branch_and_bound_against_brute_force(spark):
    r = random.Random(4)
    bundles = [(f"g{g}", f, l, r.random() < 0.6, r.randrange(9), r.randrange(3), r.randrange(3)) for g in range(60) for f in ("ann", "anne", None) for l in ("hale", "haie", "dale") if r.random() < 0.8]
    locals_ = [(f"g{g}", r.choice(["ann.hale", "haie_ann", "annedale", "dale-anne", "x"])) for g in range(60) for _ in range(r.randrange(3))]
    spelt = lambda f, l: {x + s + y for s in ("." , "_", "-", "") for x, y in ((f, l), (l, f))} if f else set()
    fits = lambda c, f, l: any(k == c and x in spelt(f, l) for k, x in locals_)
    want, plain = {}, {}
    for c, f, l, full, t, n, e in bundles:
        want.setdefault(c, []).append(((full, fits(c, f, l), t, n, e, l, f or ""), f, l))
        plain.setdefault(c, []).append(((full, t, n, e, l, f or ""), f, l))
    want, plain = ({c: max(x)[1:] for c, x in y.items()} for y in (want, plain))
    scratch = survivor.Scratch(spark, "test")
    got = survivor.search(scratch, spark.createDataFrame(bundles, BUNDLES), spark.createDataFrame(locals_, "canon string, local string").distinct())
    assert {x.canon: (x["first"], x["last"]) for x in got.collect()} == want
    assert sum(want[c] != plain[c] for c in want) > 5  # the dependency decides


# --- 6: near duplicates ------------------------------------------------------------------------------------------------------


def brute_pairs(texts, t=0.5):
    sets = {}
    for k, x in texts.items():
        w = re.findall(r"[^\W_]+", (x or "").lower())
        if s := set(zip(w, w[1:], w[2:])):
            sets[k] = s
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_similar_pairs_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for k in range(0, 60, 3):
        n = r.choice([4, 12, 45, 90, 300])
        base = [r.choice(words) for _ in range(n)]
        texts[k] = " ".join(base)
        edited = [x if r.random() > 0.06 else r.choice(words) for x in base]
        texts[k + 1] = " ".join(edited)
        texts[k + 2] = " ".join(base[: int(n * 0.8)])
    texts |= {100: None, 101: "", 102: "one two", 103: texts[0], 104: texts[0].upper()}
    # A stock passage in many texts, more than a common fingerprint may have.
    stock = " ".join(r.choice(words) for _ in range(40))
    for k in range(200, 230):
        texts[k] = stock + " " + " ".join(r.choice(words) for _ in range(60 if k < 226 else 4))
    df = spark.createDataFrame([(k, x, "c", 1) for k, x in texts.items()], "doc_id long, text string, class string, doc int")
    assert {tuple(x) for x in neardup.similar_pairs(df).collect()} == brute_pairs(texts)
    g = {x.doc: (x["class"], x.links, x.group) for x in neardup.similar_groups(df).collect()}
    assert g[103][0] == g[0][0] == g[104][0] == 0 and 102 not in g and 100 not in g
    for a, b in brute_pairs(texts):
        assert g[a][2] == g[b][2]
    assert neardup.similar_pairs(df.limit(0)).count() == 0


def test_similar_pairs_of_the_test_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    assert {tuple(x) for x in neardup.similar_pairs(d).collect()} == brute_pairs(texts)


def family(rng, versions, words, edits, fresh):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(versions):
        text = list(base)
        for at in rng.sample(range(words), edits):
            text[at] = fresh()
        yield " ".join(text)


@pytest.mark.parametrize("hot", [0, 2])
def test_fragments_lose_nothing(spark, monkeypatch, hot):
    rng = random.Random(hot)
    fresh = lambda: f"x{rng.randrange(10**6)}"
    stock = " ".join(f"s{k}" for k in range(60))
    texts = [*family(rng, 25, 60, 4, fresh), *family(rng, 10, 200, 16, fresh), *[stock + " " + " ".join(fresh() for _ in range(90)) for _ in range(20)], *[stock + " " + fresh() for _ in range(4)], "one two three", "one two three"]
    few = random.Random(7)
    texts += [" ".join(few.choice("abcdefgh") for _ in range(30)) for _ in range(25)]
    rows = list(enumerate(texts))
    want = brute_pairs(dict(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in neardup.fragment_pairs(df.selectExpr("doc_id AS doc", "text"), 0.5).select("da", "db").collect()} >= want
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "_CHUNK", 8)
    assert {tuple(x) for x in neardup.similar_pairs(df).collect()} == want and len(want) > 100


def test_a_stock_paragraph_costs_in_proportion(spark):
    rng = random.Random(1)
    stock = " ".join(f"s{k}" for k in range(150))
    looked = []
    for n in (300, 1200):
        rows = [(k, " ".join(f"w{rng.randrange(10**7)}" for _ in range(220)) + " " + stock) for k in range(n)]
        near = neardup.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert near.links.count() == 0
        docs = spark.createDataFrame(rows, "doc long, text string")
        assert neardup.fragment_pairs(docs, 0.5).count() == 0
        looked.append(near.met.where("doc IS NULL AND a <> b").select("a", "b").distinct().count())
    assert looked[1] < 8 * max(looked[0], 1000)  # four times the texts; their pairs are sixteen times as many


def test_unrelated_texts_of_one_trade_are_not_kept_as_pairs(spark):
    """Texts put together from the same phrases agree in bands by chance, the more of them the larger the corpus; such meetings must end in memory."""
    rng = random.Random(5)
    phrases = [" ".join(f"p{k}x{i}" for i in range(8)) for k in range(100)]
    texts = [" ".join(rng.sample(phrases, 25)) for _ in range(400)]
    for text in texts[:20]:
        words = text.split()
        for k in range(0, len(words), 12):
            words[k] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    near = neardup.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_pairs(dict(rows))
    assert {(x.a, x.b) for x in near.links.collect()} == want and len(want) >= 20
    assert near.met.where("doc IS NULL AND a <> b").select("a", "b").distinct().count() < 800


# --- 7: leaks ------------------------------------------------------------------------------------------------------------------


def edit_in_text(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        last, row = row, [i]
        for j, y in enumerate(t, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_myers_against_dynamic_programming():
    r = random.Random(1)
    for _ in range(300):
        p = [r.randrange(4) for _ in range(r.randrange(1, 70))]
        t = [r.randrange(4) for _ in range(r.randrange(0, 90))]
        assert leak.myers(p, t) == edit_in_text(p, t)
    assert leak.myers([], [1]) == 0


def test_leaks(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = {k: [r.choice(words) for _ in range(60)] for k in range(8)}
    noise = lambda n: [r.choice(words) for _ in range(n)]
    part = items[1][20:46]
    part[5], part[15] = "changed", "too"
    docs = {
        0: [*noise(80), *items[0], *noise(40)],
        1: [*noise(10), *part, *noise(300)],
        2: [*noise(50), *items[2][:9], *noise(50)],  # a short quotation
        3: noise(100),
        4: [*items[3][:30], *noise(20), *items[4][25:55]],
    }
    rows = [(k, " ".join(w).upper() if k == 0 else ",\n".join(w)) for k, w in docs.items()] + [(5, None), (6, ""), (None, "x"), (0, " ".join(docs[0]))]
    d = spark.createDataFrame([(*x, "i") for x in rows], "doc_id long, text string, item string")
    i = spark.createDataFrame([*[(k, " ".join(w)) for k, w in items.items()], (90, None), (91, "two words"), (92, "")], "item_id long, text string")
    want = {(0, 0), (1, 1), (4, 3), (4, 4)}
    assert {tuple(x) for x in leak.leaked_items(d, i).collect()} == want
    assert leak.leaked_items(d, i).count() == len(want)
    assert leak.leaked_items(d.limit(0), i).count() == 0 and leak.leaked_items(d, i.limit(0)).count() == 0


@pytest.mark.parametrize(("versions", "words", "edits"), [(40, 300, 15), (200, 300, 15), (40, 90, 5)])
def test_similar_pairs_of_a_large_family(spark, versions, words, edits):
    rng = random.Random(versions + words)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    texts = {}
    for k in range(versions):
        text = list(base)
        for at in rng.sample(range(words), edits):
            text[at] = f"x{rng.randrange(10**6)}"
        texts[k] = " ".join(text)
    want = brute_pairs(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {tuple(x) for x in neardup.similar_pairs(df).collect()}
    assert len(want) > 100 and got == want


def test_a_leak_whose_stretch_has_not_the_most_pieces():
    words = [f"w{k}" for k in range(50)]
    doc = [f"x{k}" if 12 <= k < 30 or k in (31, 34, 37, 40) else w for k, w in enumerate(words)]
    item = leak.Item.of(hash_words([" ".join(words)])[0])
    assert item.leaks(hash_words([" ".join(doc)])[0])
    doc[43] = doc[46] = "y"
    assert not item.leaks(hash_words([" ".join(doc)])[0])


@pytest.mark.parametrize("words", [3, 8, 10, 12, 13, 18, 25, 50, 100, 300])
def test_no_passage_within_the_budget_is_lost(words):
    r = random.Random(words)
    for _ in range(100):
        w = [f"w{r.randrange(10**6)}" for _ in range(words)]
        item = leak.Item.of(hash_words([" ".join(w)])[0])
        assert 1 <= item.need and item.size * (item.budget + 1) <= item.stretch
        s = r.randrange(words - item.stretch + 1)
        passage = w[s : s + item.stretch]
        for _ in range(item.budget):
            kind, at = r.randrange(3), r.randrange(len(passage))
            passage[at : at + (kind < 2)] = [f"y{r.randrange(10**6)}"] * (kind != 1)
        noise = lambda: [f"x{r.randrange(10**6)}" for _ in range(40)]
        assert item.leaks(hash_words([" ".join([*noise(), *passage, *noise()])])[0])


def test_leaks_of_many_documents_against_every_pair(spark, monkeypatch):
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)]  # a small vocabulary, so that pieces hit by chance
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([3, 9, 20, 45])))) for k in range(12)]
    docs = [(k, " ".join(r.choice(words) for _ in range(150))) for k in range(25)]
    docs += [(100 + k, docs[k][1] + " " + t) for k, t in items]
    texts, asked = hash_words([t for _, t in docs]), hash_words([t for _, t in items])
    want = {(d, i) for a, (d, _) in enumerate(docs) for b, (i, _) in enumerate(items) if leak.Item.of(asked[0][asked[1][b] : asked[1][b + 1]]).leaks(texts[0][texts[1][a] : texts[1][a + 1]])}
    for held in (leak.HELD, 0):  # looked up in the tasks, and joined
        monkeypatch.setattr(leak, "HELD", held)
        got = leak.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(100 + k, k) for k, _ in items} <= want and sorted(map(tuple, got)) == sorted(want)
