import random

import pytest

from epistola.operators import browse, cleaning, components, merge, network, resolve, search
from epistola.operators.headers import header_filter, parse_messages

MAIL = 'From: "Stone, Ana" <stone.ana@epa.gov>\nTo: a.b@x.org; c.d@y.org\nCC: z.z@q.org\nSubject: s\n'


def docs(spark, *texts):
    return spark.createDataFrame([(f"h{i}", 2001, t) for i, t in enumerate(texts)], "hash_id string, year int, text string")


def test_headers(spark):
    rows = parse_messages(docs(spark, MAIL, "CC: only.copy@x.org", None, "", "From:\n  evan.marsh@epa.govl")).orderBy("hash_id").collect()
    assert [r.hash_id for r in rows] == ["h0", "h4"]
    assert rows[0].from_list == ["stone.ana@epa.gov"] and rows[0].to_list == ["a.b@x.org", "c.d@y.org"] and rows[0].cc_list == ["z.z@q.org"]
    assert rows[0].display_names == {"stone.ana@epa.gov": "Ana Stone"}
    assert rows[1].from_list == ["evan.marsh@epa.gov"]
    assert docs(spark, MAIL, "x").where(header_filter()).count() == 1


def test_network_counts(spark):
    m = parse_messages(docs(spark, "From: aa@x.org\nAuthor: bb@x.org\nTo: cc@y.org\n"))
    n = {r.email: (r.sent, r.received) for r in network.node_stats(m).collect()}
    assert n == {"aa@x.org": (1, 0), "bb@x.org": (1, 0), "cc@y.org": (0, 1)}
    assert network.edge_stats(m).count() == 2


def test_network_build(spark):
    nodes, edges = network.build_network(docs(spark, MAIL, MAIL.replace("stone.ana", "ana.stone"), "From: none"))
    assert {r.id: r.sent for r in nodes.collect()}["ana.stone@epa.gov"] == 6
    assert {(r.source, r.target): r.weight for r in edges.collect()}[("ana.stone@epa.gov", "a.b@x.org")] == 2
    empty = network.build_network(docs(spark, "x"))
    assert empty[0].count() == 0 and empty[1].count() == 0


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


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(40)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == union_find(pairs)


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0
    one = components.components(spark.createDataFrame([("x", "x"), (None, "y")], "a string, b string")).collect()
    assert [tuple(r) for r in one] == [("x", "x")]


def test_chains(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("t", "x"), ("n", None)], "src string, dst string")
    assert {r.src: r.dst for r in components.follow_chains(m).collect()} == {"a": "c", "b": "c", "x": "x", "y": "y", "t": "x"}


@pytest.mark.parametrize("seed", range(3))
def test_chains_against_walking(spark, seed):
    r = random.Random(seed)
    step = {f"c{i}": f"c{i + 1}" for i in range(40)} | {f"r{i}": f"r{(i + 1) % 7}" for i in range(7)} | {f"t{i}": f"t{i + 1}" if i < 9 else "r3" for i in range(10)}
    step |= {f"n{i}": f"n{r.randrange(60)}" for i in range(50)}
    step = {a: b for a, b in step.items() if a != b}

    def walk(x):
        seen = set()
        while x in step and x not in seen:
            seen.add(x)
            x = step[x]
        return x

    got = components.follow_chains(spark.createDataFrame(list(step.items()), "src string, dst string"))
    assert {x.src: x.dst for x in got.collect()} == {x: walk(x) for x in step}


def graph(spark, *rows):
    return spark.createDataFrame([(i, n, i.split("@")[-1], c, 0, c, [2001], 1) for i, n, c in rows], "id string, name string, domain string, sent long, received long, count long, years array<int>, domain_count long")


def test_layers(spark):
    n = graph(spark, ("quill.bo@d.org", "Bo Quill", 9), ("quiil.bo@d.org", "Bo Quill", 3), ("ana@d.org", "", 1), ("ana.stone@d.org", "", 5), ("anastone@d.org", "", 1), ("busyone.aa@e.org", "Al Xu", 60), ("busyone.ab@e.org", "Oz Wy", 70))
    r = resolve.Resolution(n).run()
    best = {x.orig_id: x.canon for x in r.state.collect()}
    assert best["quill.bo@d.org"] == best["quiil.bo@d.org"]
    assert best["ana@d.org"] == best["ana.stone@d.org"] == best["anastone@d.org"]
    assert best["busyone.aa@e.org"] != best["busyone.ab@e.org"]
    assert [x for x, _ in r.changes] == ["structural", "domain", "local", "split", "prefix", "fuzzy", "single", "concat", "same_name"]
    ids = merge.best_ids(r.state, n)
    merged = merge.merge_nodes(n, ids)
    edges = spark.createDataFrame([("quill.bo@d.org", "ana@d.org", 2, [2001], ["h"]), ("quiil.bo@d.org", "ana.stone@d.org", None, [2002], ["i"]), ("ana@d.org", "ana.stone@d.org", 1, None, None)], "source string, target string, weight long, years array<int>, doc_ids array<string>")
    e = merge.merge_edges(edges, ids).collect()
    assert len(e) == 1 and e[0].weight == 3 and e[0].years == [2001, 2002] and e[0].doc_ids == ["h", "i"]
    assert {x.check: x.bad for x in merge.invariants(n, merged, merge.merge_edges(edges, ids)).collect()} == dict.fromkeys(["count_conserved", "ends_exist", "no_loops", "unique_ids"], 0)


def test_layers_on_empty_graph(spark):
    r = resolve.Resolution(graph(spark, ("a@b", None, 1)).limit(0)).run()
    assert r.state.count() == 0


def test_single_needs_five_times(spark):
    n = graph(spark, ("ana@d.org", "", 1), ("ana.stone@d.org", "", 100), ("ana.hale@d.org", "", 30))
    assert resolve.Resolution(n).single_to_full().count() == 0


def test_fuzzy_pairs_match_brute_force(spark, small):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = resolve.Resolution(spark.read.parquet(f"{small}/nodes.parquet"))
    c = [(x.canon, x.local, x.domain) for x in r.canons().collect() if len(x.local) >= 2]
    want = set()
    for a in c:
        for b in c:
            if a[2] == b[2] and (len(a[1]), a[1], a[0]) < (len(b[1]), b[1], b[0]) and lev(a[1], b[1]) <= max(2, len(a[1]) // 5):
                want.add((a[0], b[0]))
    assert {(x.canon_a, x.canon_b) for x in r.fuzzy_candidates().collect()} == want


def broadcasts(df):
    """The parts of the plan, made before anything runs, that would go through the driver to all tasks."""
    found, todo = [], [df._jdf.queryExecution().sparkPlan()]
    while todo:
        p = todo.pop()
        kids = [p.children().apply(i) for i in range(p.children().size())]
        if p.nodeName() == "BroadcastHashJoin":
            found.append(str(kids[p.buildSide().toString() == "BuildRight"].toString()))
        todo += kids
    return found


def test_stripped_prefixes_broadcast_no_cuts(spark, small):
    """The cuts of a part are many times the table they come from; the planner's estimate of them is that table's."""
    r = resolve.Resolution(spark.read.parquet(f"{small}/nodes.parquet"))
    assert not [x for x in broadcasts(r.stripped_prefixes()) if "Generate" in x]


def test_fuzzy_pairs_broadcast_no_pieces(spark, small):
    """Pieces, and still more the substrings they meet, are many times the table they come from."""
    r = resolve.Resolution(spark.read.parquet(f"{small}/nodes.parquet"))
    assert not [x for x in broadcasts(r.fuzzy_candidates()) if "Generate" in x]


def test_layers_broadcast_no_table_of_all_nodes(spark, small):
    r = resolve.Resolution(spark.read.parquet(f"{small}/nodes.parquet"))
    for layer in (r.split_locals, r.single_to_full, r.concatenated):
        assert not broadcasts(layer())


def test_cleaning(spark):
    r = cleaning.clean(docs(spark, "Th e plan\f was pre-\n vented.Tbe  end, quickly", None, "")).orderBy("hash_id").collect()
    assert r[0].cleaned == "the plan was prevented. The end, quickly"
    assert r[0].stats["control_chars_removed"] == 1 and r[0].stats["broken_word_the"] == 1 and r[0].stats["char_fix_The"] == 1
    assert r[1].cleaned is None and r[1].total_changes == 0 and not r[1].text_changed and not r[2].text_changed
    assert cleaning.document_counters(cleaning.clean(docs(spark, "a").limit(0))).first().percent is None


def test_dictionary(spark):
    d = spark.createDataFrame([("plant", 5000), ("plans", 4000), ("rare", 3)], "term string, count long")
    got = cleaning.dictionary_fixes(docs(spark, "the plannt and plantt of raree"), d)
    assert {(r.word, r.term) for r in got.collect()} == {("plannt", "plant"), ("plantt", "plant")}


def test_search(spark):
    d = docs(spark, "x ana.stone@mail.d.org and bo@e.org", "only ana.stone@d.org", "ANA.STONE@D.ORG bo@e.org")
    got = search.correspondence(d, "ana.stone@d.org", "bo@e.org").collect()
    assert [r.hash_id for r in got] == ["h0", "h2"] and got[0].url.endswith("/h0/h0/h0.pdf")
    assert search.correspondence(d, "zz@d.org", "bo@e.org", ["zz@d.org", "ana.stone@d.org"]).count() == 2
    assert search.bundle_key("b@x", "a@x") == "bundles/a@x___b@x.zip"
    with pytest.raises(ValueError):
        search.address_pattern("nobody")


def test_unmatched(spark):
    n = graph(spark, ("ana@d.org", "A", 1), ("bo@d.org", "B", 5), ("odd name@d.org", "O", 2), ("gone name@d.org", "G", None))
    d = docs(spark, "see joana@d.organic", "ODD NAME@D.ORG", None)
    assert [r.email for r in search.unmatched(n, d).collect()] == ["bo@d.org", "gone name@d.org"]


def test_ids_that_no_token_holds(spark):
    n = graph(spark, ("ab", "A", 1), ("a b@d", "B", 2), ("\u00e9t\u00e9 x@d.org", "C", 3), ("long odd name@d.org", "D", 4), ("?", "E", 5), ("", "F", 6))
    d = docs(spark, "the AB is here", "A B@D and long odd names@d.org", "\u00c9T\u00c9 X@D.ORG", "long odd name", None)
    assert [r.email for r in search.unmatched(n, d).collect()] == ["?", "long odd name@d.org"]
    assert search.unmatched(n, d.limit(0)).count() == 6 and search.unmatched(n.limit(0), d).count() == 0


def test_corrected_text(spark):
    d = spark.createDataFrame([("plant", 5000)], "term string, count long")
    got = cleaning.apply_fixes(docs(spark, "The Plannt, plantt-house and plannts\nplannt", None, "nothing"), d).orderBy("hash_id").collect()
    assert [r.corrected for r in got] == ["The plant, plant-house and plannts\nplant", None, "nothing"]


def test_browse(spark):
    d = docs(spark, "x" * 150, None)
    assert {r.name: r.type for r in browse.describe(d, "hash_id").collect()} == {"hash_id": "string", "year": "int", "text": "string (150 chars)"}
    assert [r.hash_id for r in browse.page(d, "hash_id", 1, 5).collect()] == ["h1"]
    assert [tuple(r) for r in browse.collections(spark, {"d": d, "e": d.limit(1)}).collect()] == [("d", 2), ("e", 1)]
    assert browse.sample(d, 1, key="hash_id").collect() == browse.sample(d, 1, key="hash_id").collect()
