"""Registry of the engine's own queries and their SQL twins. Each query runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epistola.functions import address as A
from epistola.functions import rules
from epistola.functions.similarity import jaro_winkler_udf
from epistola.operators import browse, cleaning, components, headers, merge, network, resolve, search
from epistola.plans import oracle as O
from epistola.session import checkpoint_dir, table
from epistola.streaming import network as stream

FLAGSHIP = "agg2_edge_stats"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def joined(*cols: str) -> list[Column]:
    return [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in cols]


def s_joined(*cols: str) -> str:
    return ", ".join(f"array_to_string({c}::VARCHAR[], ',') AS {c}" for c in cols)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def mails(spark: SparkSession, d: str) -> DataFrame:
    return headers.parse_messages(docs(spark, d).where(headers.header_filter()))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes")


# --- headers and network -----------------------------------------------------------------------------------------------


@query("SELECT hash_id FROM documents WHERE regexp_matches(text, '(?i)From:.*@') AND regexp_matches(text, '(?i)To:.*@')")
def flt1_header_filter(spark, d):
    return docs(spark, d).where(headers.header_filter()).select("hash_id")


@query(f"""WITH {O.messages()} SELECT hash_id, any_value(year) AS year, array_to_string(list_sort(coalesce(list(a) FILTER (kind = 'f'), [])), ',') AS from_list,
array_to_string(list_sort(coalesce(list(a) FILTER (kind = 't'), [])), ',') AS to_list, array_to_string(list_sort(coalesce(list(a) FILTER (kind = 'c'), [])), ',') AS cc_list FROM addr GROUP BY hash_id""")
def f6_parse_messages(spark, d):
    return mails(spark, d).select("hash_id", "year", *joined("from_list", "to_list", "cc_list"))


@query(f"WITH {O.messages()}, {O.stats()} SELECT email, sent, received, {s_joined('years', 'domains')} FROM nodes0")
def agg1_node_stats(spark, d):
    return network.node_stats(mails(spark, d)).select("email", "sent", "received", *joined("years", "domains"))


@query(f"WITH {O.messages()}, {O.stats()} SELECT source, target, weight, {s_joined('years', 'doc_ids')} FROM edges0")
def agg2_edge_stats(spark, d):
    return network.edge_stats(mails(spark, d)).select("source", "target", "weight", *joined("years", "doc_ids"))


@query(f"WITH {O.messages()}, {O.stats()} SELECT source, target, hash_id FROM pair0")
def j3_sender_recipient_pairs(spark, d):
    return network.pairs(mails(spark, d)).select("source", "target", "hash_id")


@query()
def agg3_display_names(spark, d):
    return network.display_names(mails(spark, d))


@query(f"WITH {O.messages()}, {O.stats()}, {O.mapping()} SELECT email, canon FROM vmap")
def agg4_variant_map(spark, d):
    return network.variant_map(network.node_stats(mails(spark, d)))


_CONS_NODES = """cn AS (SELECT canon AS id, sum(sent)::BIGINT AS sent, sum(received)::BIGINT AS received, list_sort(list_distinct(flatten(list(years)))) AS years, list_sort(list_distinct(flatten(list(domains)))) AS domains, list_sort(list(DISTINCT email)) AS aliases FROM nodes0 JOIN vmap USING (email) GROUP BY canon)"""
_CONS_EDGES = """ce AS (SELECT s.canon AS source, t.canon AS target, sum(weight)::BIGINT AS weight, list_sort(list_distinct(flatten(list(years)))) AS years, list_sort(list_distinct(flatten(list(doc_ids)))) AS doc_ids FROM edges0 e JOIN vmap s ON s.email = e.source JOIN vmap t ON t.email = e.target WHERE s.canon <> t.canon GROUP BY 1, 2)"""


@query(f"WITH {O.messages()}, {O.stats()}, {O.mapping()}, {_CONS_NODES} SELECT id AS email, sent, received, {s_joined('years', 'domains', 'aliases')} FROM cn")
def agg5_consolidated_nodes(spark, d):
    n = network.node_stats(mails(spark, d))
    return network.consolidate_nodes(n, network.variant_map(n)).select("email", "sent", "received", *joined("years", "domains", "aliases"))


@query(f"WITH {O.messages()}, {O.stats()}, {O.mapping()}, {_CONS_EDGES} SELECT source, target, weight, {s_joined('years', 'doc_ids')} FROM ce")
def agg6_consolidated_edges(spark, d):
    m, _ = network.parsed_once(docs(spark, d).where(headers.header_filter()))
    return network.remap_edges(network.edge_stats(m), network.variant_map(network.node_stats(m))).select("source", "target", "weight", *joined("years", "doc_ids"))


@query()
def flt6_export_nodes(spark, d):
    return network.build_network(docs(spark, d), min_count=2)[0].select("id", "name", "domain", "sent", "received", "count", "domain_count", *joined("years", "aliases"))


@query(f"""WITH {O.messages()}, {O.stats()}, {O.mapping()}, {_CONS_NODES}, {_CONS_EDGES}, ok AS (SELECT id FROM cn WHERE sent + received >= 2)
SELECT source, target, weight, {s_joined('years', 'doc_ids')} FROM ce WHERE weight >= 2 AND source IN (SELECT id FROM ok) AND target IN (SELECT id FROM ok)""")
def flt7_export_edges(spark, d):
    return network.build_network(docs(spark, d), min_count=2, min_weight=2)[1].select("source", "target", "weight", *joined("years", "doc_ids"))


@query("SELECT domain, count(*) AS count FROM nodes WHERE domain <> '' GROUP BY domain ORDER BY count DESC, domain LIMIT 50")
def srt2_top_domains(spark, d):
    return network.top_domains(nodes(spark, d))


@query("SELECT id, count FROM nodes ORDER BY count DESC NULLS LAST, id")
def srt1_top_nodes(spark, d):
    return nodes(spark, d).select("id", "count").orderBy(F.desc_nulls_last("count"), "id")


@query("SELECT hash_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(to_list, []), coalesce(cc_list, [])))), ',') AS recipients FROM messages")
def set1_recipients(spark, d):
    e = F.expr("cast(array() as array<string>)")
    return table(spark, d, "messages").select("hash_id", F.array_join(F.array_sort(F.array_union(F.coalesce("to_list", e), F.coalesce("cc_list", e))), ",").alias("recipients"))


@query("""WITH m AS (SELECT DISTINCT ON (hash_id) hash_id, year, from_list, to_list, cc_list FROM messages ORDER BY hash_id, loaded_at DESC, sent_at DESC NULLS LAST, year DESC NULLS LAST),
s AS (SELECT DISTINCT hash_id, year, unnest(from_list) AS a FROM m), r AS (SELECT DISTINCT hash_id, unnest(list_concat(to_list, cc_list)) AS a FROM m)
SELECT s.a AS source, r.a AS target, count(*) AS weight FROM s JOIN r USING (hash_id) WHERE s.a <> r.a GROUP BY 1, 2""")
def agg2_message_edges(spark, d):
    m = table(spark, d, "messages").groupBy("hash_id").agg(F.max(F.struct("loaded_at", "sent_at", "year", "from_list", "to_list", "cc_list")).alias("m")).select("hash_id", "m.*")
    return network.edge_stats(m).select("source", "target", "weight")


# --- functions over every node ---------------------------------------------------------------------------------------------


def over_nodes(name: str, spark_expr: Callable[[], Column], sql_expr: str | None, column: str = "value") -> None:
    def f(spark, d):
        return nodes(spark, d).select("id", spark_expr().alias(column))

    f.__name__ = name
    QUERIES[name] = f
    if sql_expr:
        SQL[name] = f"SELECT id, {sql_expr} AS {column} FROM nodes"


over_nodes("flt5_valid_address", lambda: A.is_valid("id"), O.valid("id"))
over_nodes("f9_domain", lambda: A.domain_of("id"), O.domain("id"))
over_nodes("f10_build_domain", lambda: A.build_domain(A.rest_of("id")), O.build_domain(O.rest("id")))
over_nodes("f12_build_address", lambda: A.build_address("id"), O.build_address("id"))
over_nodes("f13_canonical_address", lambda: A.canonical_address("id"), O.canonical("id"))
over_nodes("f13_sorted_local", lambda: A.sorted_local(A.local_of("id")), O.sorted_local(O.local("id")))
over_nodes("f15_structural", lambda: A.structural("id"), O.cleaned("id"))
over_nodes("f18_match_local", lambda: A.match_local(A.local_of("id")), O.replaced(O.local("id"), rules.LOCAL_CHARACTERS))
def _display_sql(x: str) -> str:
    """Captured neighbours instead of lookaround, twice over, so that neighbours that share a letter are both seen."""
    for a, b in rules.DISPLAY_INNER:
        for _ in range(2):
            x = f"regexp_replace({x}, '([a-z]){a}([a-z])', '\\1{b}\\2', 'g')"
    for a, b in rules.DISPLAY_FIRST:
        x = f"regexp_replace({x}, '^{a}([a-z]{{3,}})', '{b}\\1')"
    return f"CASE WHEN regexp_matches(p, '^[0-9]+$') THEN p ELSE {x} END"


over_nodes("f19_display_local", lambda: A.display_local(A.local_of("id")), f"array_to_string(list_transform(regexp_extract_all({O.local('id')}, '[._]|[^._]+'), lambda p: {_display_sql('p')}), '')")
over_nodes("f21_title", lambda: A.title("name"), O.title("name"))
over_nodes("f22_name_distance", lambda: F.levenshtein(F.lower(A.local_of("id")), F.lower(A.sorted_local(A.local_of("id")))).cast("long"), f"levenshtein(lower({O.local('id')}), lower({O.sorted_local(O.local('id'))}))::BIGINT")
over_nodes("f23_jaro_winkler", lambda: F.round(jaro_winkler_udf(F.lower("name"), F.replace(A.local_of("id"), F.lit("."), F.lit(" "))), 9), None)
SQL["f23_jaro_winkler"] = f"WITH RECURSIVE jp AS (SELECT id AS k, lower(name) AS a, replace({O.local('id')}, '.', ' ') AS b FROM nodes WHERE name IS NOT NULL), {O.jaro_winkler('jp')} SELECT id, round(jw, 9) AS value FROM nodes LEFT JOIN jw ON k = id"
_ROLES = O.listed(sorted(rules.GENERIC_LOCALS))
_SPLIT = lambda x: f"CASE WHEN length({x}) >= 5 AND regexp_matches({x}, '^\\p{{Lu}}\\S{{3,}}$') AND lower({x}) NOT IN ({O.listed(sorted(rules.FIRST_NAMES | rules.GENERIC_LOCALS))}) THEN left({x}, 1) || '. ' || {O.title(f'substr({x}, 2)')} END"
_PARTS = O.parts(O.local("id"))
_W = "list_filter(string_split_regex(name, '\\s+'), lambda w: length(w) > 0)"
over_nodes("f24_split_initial", lambda: merge.split_initial(A.title(A.local_of("id"))), _SPLIT(f"({O.title(O.local('id'))})"))
over_nodes(
    "f25_name_from_id",
    lambda: merge.name_from_id(F.col("id")),
    f"""CASE WHEN NOT contains(id, '@') OR len({_PARTS}) = 0 THEN '' WHEN len({_PARTS}) = 1 THEN CASE WHEN lower({_PARTS}[1]) IN ({_ROLES}) THEN '' ELSE coalesce({_SPLIT(f"({O.title(f'{_PARTS}[1]')})")}, {O.title(f'{_PARTS}[1]')}) END
    ELSE array_to_string(list_transform({_PARTS}, lambda p: {O.title('p').replace('lambda x', 'lambda y').replace('(x,', '(y,')}), ' ') END""",
)
over_nodes("f26_name_order", lambda: merge.fixed_order(F.col("name"), F.col("id"), F.lit("epa.gov")), f"CASE WHEN len({_W}) = 2 AND len({_PARTS}) = 2 AND lower({_W}[1]) = {_PARTS}[1] AND lower({_W}[2]) = {_PARTS}[2] THEN {_W}[2] || ' ' || {_W}[1] ELSE name END")
over_nodes("agg9_name_key", lambda: resolve.name_key("name"), "CASE WHEN len(list_filter(string_split_regex(lower(name), '\\s+'), lambda x: length(x) > 0)) >= 2 THEN array_to_string(list_sort(list_filter(string_split_regex(lower(name), '\\s+'), lambda x: length(x) > 0)), ' ') END")

_NAME = "regexp_replace(regexp_replace(name, '^\\s+|\\s+$', '', 'g'), '^[\"'']+|[\"'']+$', '', 'g')"
_BAD = " OR ".join(f"contains(lower(x), {O.q(g)})" for g in rules.NAME_GARBAGE)
_WORD = lambda w: f"regexp_matches(regexp_replace({w}, '[.''\\-]', '', 'g'), '^\\p{{L}}+$')"
_WORDS = "list_filter(string_split_regex(x, '\\s+'), lambda w: length(w) > 0)"
_F8 = f"""SELECT id, CASE WHEN name IS NULL OR name = '' THEN NULL WHEN length(x) > 40 OR regexp_matches(x, '[0-9]') OR {_BAD} THEN NULL
WHEN contains(x, ',') AND length(l) > 0 AND length(f) > 0 AND {_WORD('f')} AND {_WORD('t')} AND length(f) BETWEEN 2 AND 20 AND length(t) BETWEEN 2 AND 20 THEN {O.title("f || ' ' || l")}
WHEN len({_WORDS}) BETWEEN 1 AND 4 AND len(list_filter({_WORDS}, lambda w: NOT ({_WORD('w')} AND length(w) >= 2))) = 0 THEN {O.title('x')} END AS value
FROM (SELECT *, regexp_extract(l, '\\S+$') AS t FROM (SELECT id, name, x, trim(split_part(x, ',', 1)) AS l, regexp_extract(trim(substr(x, strpos(x, ',') + 1)), '^\\S+') AS f FROM (SELECT id, name, {_NAME} AS x FROM nodes)))"""


@query(_F8)
def f8_repaired_name(spark, d):
    return nodes(spark, d).select("id", A.repaired_name("name").alias("value"))


@query(f"WITH src AS (SELECT DISTINCT domain FROM nodes WHERE domain IS NOT NULL), {O.match_domain('src', 'domain', 'domain')} SELECT domain, d AS value FROM matched")
def f16_match_domain(spark, d):
    return nodes(spark, d).where("domain IS NOT NULL").select("domain").distinct().select("domain", A.match_domain("domain").alias("value"))


@query(f"WITH src AS (SELECT DISTINCT domain FROM nodes WHERE domain IS NOT NULL), {O.match_domain('src', 'domain', 'domain', False)} SELECT domain, d AS value FROM matched")
def f16_display_domain(spark, d):
    return nodes(spark, d).where("domain IS NOT NULL").select("domain").distinct().select("domain", A.match_domain("domain", characters=False).alias("value"))


# --- entity resolution -----------------------------------------------------------------------------------------------------

_CANONS = f"canons AS (SELECT canon, {O.local('canon')} AS local, {O.rest('canon')} AS domain, sum(coalesce(count, 0))::BIGINT AS total FROM state JOIN nodes ON id = orig_id WHERE contains(canon, '@') GROUP BY 1, 2, 3)"
_STATE = f"""s0 AS (SELECT id, {O.cleaned('id')} AS c FROM nodes), {O.match_domain('s0', 'id', O.rest('c'))},
state AS (SELECT s0.id AS orig_id, CASE WHEN contains(c, '@') THEN {O.sorted_local(O.replaced(O.local('c'), rules.LOCAL_CHARACTERS))} || '@' || d ELSE c END AS canon FROM s0 JOIN matched USING (id)),
{_CANONS}"""
_KEY = lambda a, b: f"least({a}, {b}) || '|' || greatest({a}, {b})"
_TWO = f"two AS (SELECT domain, {_KEY('p[1]', 'p[2]')} AS key, min(canon) AS target FROM (SELECT *, {O.parts('local')} AS p FROM canons) WHERE len(p) = 2 GROUP BY 1, 2)"


def projected(spark: SparkSession, d: str) -> resolve.Resolution:
    """The state after the three layers that are projections: what the SQL twins of single layers begin with."""
    r = resolve.Resolution(nodes(spark, d))
    c = A.structural("orig_id")
    c = A.with_domain(c, A.match_domain)
    c = A.with_local(c, lambda l: A.sorted_local(A.match_local(l)))
    r.state = r.scratch.save(r.state.select("orig_id", c.alias("canon")))
    return r


@query(f"WITH {_STATE} SELECT orig_id, canon FROM state")
def er3_projected_map(spark, d):
    return projected(spark, d).state


@query(f"WITH {_STATE} SELECT canon, total FROM canons")
def agg8_total_counts(spark, d):
    return projected(spark, d).canons().select("canon", "total")


@query(f"""WITH {_STATE}, {_TWO}, o AS (SELECT canon, {O.rest('canon')} AS domain, min(orig_id) AS orig FROM state WHERE contains(canon, '@') GROUP BY 1, 2),
w AS (SELECT canon, domain, {O.parts(O.local('c'))} AS p FROM o JOIN s0 ON s0.id = o.orig), v AS (SELECT * FROM w WHERE len(p) >= 3),
t AS (SELECT canon, domain, i AS ord, CASE WHEN len(p) = 3 THEN [p[1]||p[2], p[2]||p[1], p[1]||p[3], p[3]||p[1], p[2]||p[3], p[3]||p[2]][i + 1] ELSE array_to_string(p[1:i+1], '') END AS l,
 CASE WHEN len(p) = 3 THEN [p[3], p[3], p[2], p[2], p[1], p[1]][i + 1] ELSE array_to_string(p[i+2:], '') END AS r FROM v, unnest(range(CASE WHEN len(p) = 3 THEN 6 ELSE len(p) - 1 END)) AS u(i)),
k AS (SELECT canon, domain, ord, 0 AS o, {_KEY(O.replaced('l', rules.LOCAL_CHARACTERS), O.replaced('r', rules.LOCAL_CHARACTERS))} AS key FROM t WHERE length(l) >= 2 AND length(r) >= 2 UNION ALL SELECT canon, domain, ord, 1, {_KEY('l', 'r')} FROM t WHERE length(l) >= 2 AND length(r) >= 2)
SELECT canon AS src, min_by(target, (ord, o)) AS dst FROM k JOIN two USING (domain, key) WHERE target <> canon GROUP BY canon""")
def er3b_split_locals(spark, d):
    return projected(spark, d).split_locals()


@query(f"""WITH {_STATE}, {_TWO}, kn AS (SELECT DISTINCT domain, known FROM (SELECT domain, unnest(p) AS known FROM (SELECT domain, {O.parts('local')} AS p FROM canons) WHERE len(p) = 2) WHERE length(known) >= 3),
pp AS (SELECT canon, domain, list_filter(string_split_regex(local, '[._\\-]'), lambda x: length(x) > 0) AS p FROM canons), one AS (SELECT canon, domain, p, i, p[i] AS part FROM pp, unnest(range(1, len(p) + 1)) AS u(i) WHERE len(p) >= 2),
c AS (SELECT canon, domain, p, i, 0 AS side, right(part, n) AS known FROM one, unnest(range(3, length(part))) AS v(n) UNION ALL SELECT canon, domain, p, i, 1, left(part, n) FROM one, unnest(range(3, length(part))) AS v(n)),
h AS (SELECT canon, domain, i, side, known, list_filter(list_concat(list_concat(p[1:i-1], [known]), p[i+1:]), lambda x: length(x) > 1) AS z FROM c JOIN kn USING (domain, known))
SELECT canon AS src, min_by(target, (i, side, -length(known), known)) AS dst FROM (SELECT *, {_KEY('z[1]', 'z[2]')} AS key FROM h WHERE len(z) = 2) JOIN two USING (domain, key) WHERE target <> canon GROUP BY canon""")
def er3c_stripped_prefixes(spark, d):
    return projected(spark, d).stripped_prefixes()


@query(f"""WITH {_STATE}, x AS (SELECT canon, local, domain, length(local) AS n FROM canons WHERE length(local) >= 2 AND domain <> '')
SELECT a.canon AS canon_a, b.canon AS canon_b, levenshtein(a.local, b.local)::BIGINT AS dist FROM x a JOIN x b USING (domain)
WHERE (a.n, a.local, a.canon) < (b.n, b.local, b.canon) AND b.n - a.n <= greatest(2, a.n // 5) AND levenshtein(a.local, b.local) <= greatest(2, a.n // 5)""")
def j7_fuzzy_pairs(spark, d):
    return projected(spark, d).fuzzy_candidates().select("canon_a", "canon_b", F.col("dist").cast("long").alias("dist"))


_WORDS_OF = lambda x: f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: length(w) > 0)"
_BEST = f"""fq AS (SELECT canon, name, sum(coalesce(count, 1))::BIGINT AS freq FROM state JOIN nodes ON id = orig_id WHERE name <> '' GROUP BY 1, 2),
bn AS (SELECT canon, arg_max(name, (len({_WORDS_OF('name')}) >= 2, name = {O.title('name')}, -({" + ".join(f"contains(lower(name), {O.q(p)})::INT" for p in ('rn', 'ii', 'ffl', 'ffi', '0', '1', '3'))}), freq, name)) AS name FROM fq GROUP BY canon)"""


def _led(pairs: str, out: str) -> str:
    """CTEs from ``pairs(ca, cb)`` to ``out(src, dst)``: components, each led by its member of most traffic, then greatest address."""
    return f"""e{out} AS (SELECT ca AS a, cb AS b FROM {pairs} UNION SELECT cb, ca FROM {pairs}), r{out} AS (SELECT a AS id, a AS seen FROM e{out} UNION SELECT r.id, e.b FROM r{out} r JOIN e{out} e ON r.seen = e.a),
c{out} AS (SELECT id, min(seen) AS comp FROM r{out} GROUP BY 1), l{out} AS (SELECT comp, arg_max(canon, (total, canon)) AS dst FROM c{out} JOIN canons ON canon = id GROUP BY 1),
{out} AS (SELECT id AS src, dst FROM c{out} JOIN l{out} USING (comp) WHERE id <> dst)"""


@query(f"""WITH RECURSIVE {_STATE}, {_BEST}, x AS (SELECT canon, local, domain, total, name, length(local) AS n FROM canons LEFT JOIN bn USING (canon) WHERE length(local) >= 2 AND domain <> ''),
c0 AS (SELECT a.canon AS ca, b.canon AS cb, levenshtein(a.local, b.local) AS dist, greatest(2, a.n // 5) AS bound, a.name AS na, b.name AS nb, a.local AS la, b.local AS lb, least(a.total, b.total) AS lo, greatest(a.total, b.total) AS hi
FROM x a JOIN x b USING (domain) WHERE (a.n, a.local, a.canon) < (b.n, b.local, b.canon) AND b.n - a.n <= greatest(2, a.n // 5) AND levenshtein(a.local, b.local) <= greatest(2, a.n // 5)),
c1 AS (SELECT *, coalesce(na <> '' AND nb <> '', false) AS named, lo > 50 AND hi / greatest(lo, 1) < 2 AS busy FROM c0), c2 AS (SELECT *, named AND (dist = bound OR busy) AS unsure FROM c1),
jp AS (SELECT ca || ' ' || cb AS k, lower(na) AS a, lower(nb) AS b FROM c2 WHERE unsure), {O.jaro_winkler('jp')},
ok AS (SELECT ca, cb FROM c2 WHERE NOT unsure AND NOT (busy AND NOT named) UNION ALL SELECT ca, cb FROM c2 JOIN jw ON k = ca || ' ' || cb WHERE unsure AND (NOT busy OR jw >= 0.95) AND (dist < bound OR jw >= 0.85
 OR len(list_intersect({_WORDS_OF('na')}, {_WORDS_OF('nb')})) / greatest(1, len(list_distinct(list_concat({_WORDS_OF('na')}, {_WORDS_OF('nb')})))) >= 0.4 OR len(list_intersect({O.parts('la', 3)}, {O.parts('lb', 3)})) > 0)),
{_led('ok', 'led')} SELECT src, dst FROM led""")
def er4_fuzzy_merges(spark, d):
    return projected(spark, d).fuzzy()


@query(f"""WITH {_STATE}, p AS (SELECT canon, local, domain, total, {O.parts('local')} AS p FROM canons), f AS (SELECT DISTINCT domain, canon, total, unnest(p) AS part FROM p WHERE len(p) > 1),
g AS (SELECT domain, part, count(*) AS n, max((total, canon)) AS t, max(total) AS top, list_sort(list(total), 'DESC')[2] AS second FROM f GROUP BY 1, 2)
SELECT o.canon AS src, struct_extract_at(t, 2) AS dst FROM p o JOIN g ON g.domain = o.domain AND g.part = o.local WHERE len(o.p) <= 1 AND (n = 1 OR (top > 0 AND (second = 0 OR top / greatest(1, second) >= 5)))""")
def er5_single_to_full(spark, d):
    return projected(spark, d).single_to_full()


@query(f"""WITH {_STATE}, {_TWO}, c AS (SELECT canon, domain, left(local, i) AS l, substr(local, i + 1) AS r FROM canons, unnest(range(2, length(local) - 1)) AS u(i) WHERE len({O.parts('local')}) <= 1 AND length(local) >= 6)
SELECT canon AS src, min(target) AS dst FROM (SELECT *, {_KEY('l', 'r')} AS key FROM c) JOIN two USING (domain, key) WHERE target <> canon GROUP BY canon HAVING count(DISTINCT target) = 1""")
def er6_concatenated(spark, d):
    return projected(spark, d).concatenated()


_LIKE = "levenshtein(a.domain, b.domain) <= greatest(3, greatest(length(a.domain), length(b.domain)) // 3)"
_PD2, _PD3 = [[0, 1], [1, 0]], [[0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]
_PD = lambda ps: "least(" + ", ".join(" + ".join(f"levenshtein(a.p[{i + 1}], b.p[{j + 1}])" for i, j in enumerate(p)) for p in ps) + ")"
_CHECK = " OR ".join(f"{x}.generic OR {x}.given OR length({x}.local) <= 4" for x in "ab")


@query(f"""WITH RECURSIVE {_STATE}, {_BEST}, k AS (SELECT canon, local, domain, total, name, array_to_string(list_sort({_WORDS_OF('name')}), ' ') AS anykey, len({_WORDS_OF('name')}) >= 2 AS two, {O.parts('local')} AS p,
 local IN ({O.listed(sorted(rules.GENERIC_LOCALS))}) AS generic, lower(local) IN ({O.listed(sorted(rules.FIRST_NAMES))}) AS given FROM canons LEFT JOIN bn USING (canon)),
h AS (SELECT domain, anykey, arg_min(canon, (-total, canon)) AS dst FROM k WHERE two GROUP BY 1, 2 HAVING count(*) > 1), s1 AS (SELECT canon AS src, dst FROM k JOIN h USING (domain, anykey) WHERE two AND canon <> dst),
free AS (SELECT * FROM k WHERE canon NOT IN (SELECT src FROM s1)), pb AS (SELECT a.canon AS ca, b.canon AS cb FROM free a JOIN free b USING (local) WHERE a.canon < b.canon AND NOT a.generic AND NOT a.given AND length(local) > 3 AND a.domain <> b.domain AND {_LIKE}),
{_led('pb', 'sb')}, rest AS (SELECT * FROM free WHERE canon NOT IN (SELECT src FROM sb) AND name <> ''),
pc AS (SELECT a.canon AS ca, b.canon AS cb FROM rest a JOIN rest b ON a.local = b.local AND a.anykey = b.anykey WHERE a.canon < b.canon AND (NOT (a.generic OR a.given OR length(a.local) <= 4) OR {_LIKE})
 UNION SELECT a.canon, b.canon FROM rest a JOIN rest b ON a.anykey = b.anykey AND a.two AND b.two WHERE a.canon < b.canon AND least(length(a.local), length(b.local)) >= 3 AND (NOT ({_CHECK}) OR {_LIKE})
 AND (levenshtein(a.local, b.local) <= greatest(2, least(length(a.local), length(b.local)) // 4)
  OR (len(a.p) = len(b.p) AND len(a.p) IN (2, 3) AND CASE WHEN len(a.p) = 2 THEN {_PD(_PD2)} ELSE {_PD(_PD3)} END <= greatest(2, length(array_to_string(a.p, '')) // 4)))),
{_led('pc', 'sc')} SELECT src, dst FROM s1 UNION ALL SELECT src, dst FROM sb UNION ALL SELECT src, dst FROM sc""")
def er7_same_name(spark, d):
    return projected(spark, d).same_name()


@query("""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM matches WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst, src FROM matches WHERE src IS NOT NULL AND dst IS NOT NULL),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def gr1_components(spark, d):
    return components.components(table(spark, d, "matches"), "src", "dst")


@query("""WITH RECURSIVE m AS (SELECT src, min(dst) AS dst FROM matches WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY src),
w AS (SELECT src, dst AS cur, [src] AS path FROM m UNION ALL SELECT w.src, m.dst, list_append(w.path, w.cur) FROM w JOIN m ON m.src = w.cur WHERE NOT list_contains(w.path, w.cur))
SELECT src, arg_max(cur, len(path)) AS dst FROM w GROUP BY src""")
def er0_follow_chains(spark, d):
    return components.follow_chains(table(spark, d, "matches").select("src", "dst"))


def resolved(spark: SparkSession, d: str) -> resolve.Resolution:
    return resolve.Resolution(nodes(spark, d)).run()


def _layers() -> str:
    """CTEs ``st0`` to ``st6(orig_id, canon)``: the state after the projections and after each merging layer, whose merges are those of the layer's own
    twin, read from the state before it."""
    steps = [f"{_STATE.replace('state AS (', 'st0 AS MATERIALIZED (', 1).rpartition('canons AS (')[0].rstrip(', ' + chr(10))}"]
    for i, layer in enumerate(("er3b_split_locals", "er3c_stripped_prefixes", "er4_fuzzy_merges", "er5_single_to_full", "er6_concatenated", "er7_same_name")):
        own = SQL[layer].removeprefix("WITH ").removeprefix("RECURSIVE ").removeprefix(_STATE)
        steps.append(f"""mg{i} AS MATERIALIZED (WITH RECURSIVE state AS (SELECT * FROM st{i}), {_CANONS} {own}),
mm{i} AS (SELECT src, min(dst) AS dst FROM mg{i} WHERE src <> dst GROUP BY src), mw{i} AS (SELECT src, dst AS cur, [src] AS path FROM mm{i} UNION ALL SELECT w.src, m.dst, list_append(w.path, w.cur) FROM mw{i} w JOIN mm{i} m ON m.src = w.cur WHERE NOT list_contains(w.path, w.cur)),
mf{i} AS (SELECT src, arg_max(cur, len(path)) AS dst FROM mw{i} GROUP BY src), st{i + 1} AS MATERIALIZED (SELECT orig_id, coalesce(dst, canon) AS canon FROM st{i} LEFT JOIN mf{i} ON src = canon)""")
    return ",\n".join(steps)


_DISPLAYED = f"array_to_string(list_transform(regexp_extract_all({O.local('c')}, '[._]|[^._]+'), lambda p: {_display_sql('p')}), '')"


def _best_ids(state: str) -> str:
    """CTEs from ``state(orig_id, canon)`` to ``best(orig_id, best_id)``."""
    node = _NODE_SCORES.replace("{state}", state)
    return f"""{node}, bs AS (SELECT canon, {O.cleaned('id')} AS c FROM top), bm AS (WITH {O.match_domain('bs', 'canon', O.rest('c'))} SELECT canon, d FROM matched),
best AS (SELECT orig_id, CASE WHEN contains(c, '@') THEN {_DISPLAYED} || '@' || d ELSE c END AS best_id FROM {state} JOIN bs USING (canon) JOIN bm USING (canon))"""


_NODE_SCORES = f"""sc0 AS (SELECT s.canon, id, coalesce(count, 0) AS c, (coalesce(domain, '') IN ('epa.gov', 'gmail.com', 'yahoo.com') OR (ends_with(coalesce(domain, ''), '.gov') AND NOT regexp_matches(domain, '[q30]')))::INT AS cl, contains({O.local('id')}, '.')::INT AS dot,
CASE WHEN coalesce(name, '') = '' THEN 0 ELSE (CASE WHEN len({_WORDS_OF('name')}) >= 2 THEN 2 ELSE 0 END) + (name = {O.title('name')} OR name = upper(name))::INT - regexp_matches(lower(name), 'rn|ii|0|1|3')::INT END AS ql FROM {{state}} s JOIN nodes ON id = s.orig_id),
top AS (SELECT canon, id FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY c DESC, cl DESC, dot DESC, ql DESC, length(id), id) AS r FROM sc0) WHERE r = 1)"""
_RESOLVED = f"{_layers()},\n{_best_ids('st6')}"


@query(f"WITH RECURSIVE {_RESOLVED} SELECT orig_id, best_id FROM best")
def er_alias_map(spark, d):
    r = resolved(spark, d)
    return merge.best_ids(r.state, nodes(spark, d))


_MOVED = " UNION ALL ".join(f"SELECT '{x}', (SELECT count(*) FROM st{i} a JOIN st{i + 1} b USING (orig_id) WHERE a.canon <> b.canon)" for i, x in enumerate(("split", "prefix", "fuzzy", "single", "concat", "same_name")))
_PLACED = f"CASE WHEN contains(c, '@') THEN {O.local('c')} || '@' || d ELSE c END"


@query(f"""WITH RECURSIVE {_layers()}, pl AS (SELECT s0.id, c, {_PLACED} AS placed FROM s0 JOIN matched USING (id)) SELECT 'structural' AS layer, (SELECT count(*) FROM pl WHERE id <> c) AS changes UNION ALL SELECT 'domain', (SELECT count(*) FROM pl WHERE c <> placed)
UNION ALL SELECT 'local', (SELECT count(*) FROM pl JOIN st0 ON orig_id = id WHERE placed <> canon) UNION ALL {_MOVED}""")
def obs1_layer_stats(spark, d):
    return resolved(spark, d).layer_stats()


@query(f"""WITH RECURSIVE {_RESOLVED}, ids AS (SELECT DISTINCT best_id AS id FROM best),
me AS (SELECT DISTINCT coalesce(s.best_id, source) AS source, coalesce(t.best_id, target) AS target FROM edges LEFT JOIN best s ON s.orig_id = source LEFT JOIN best t ON t.orig_id = target WHERE coalesce(s.best_id, source) <> coalesce(t.best_id, target))
SELECT 'count_conserved' AS "check", abs((SELECT coalesce(sum(count), 0) FROM nodes) - (SELECT coalesce(sum(count), 0) FROM best JOIN nodes ON id = orig_id))::BIGINT AS bad
UNION ALL SELECT 'ends_exist', (SELECT count(*) FROM (SELECT source AS id FROM me UNION ALL SELECT target FROM me) WHERE id NOT IN (SELECT id FROM ids)) UNION ALL SELECT 'no_loops', (SELECT count(*) FROM me WHERE source = target) UNION ALL SELECT 'unique_ids', 0""")
def er10_invariants(spark, d):
    """Over all edges, those with an end that the nodes lack included: they are what ``ends_exist`` reports."""
    n = nodes(spark, d)
    best = merge.best_ids(resolved(spark, d).state, n)
    merged = merge.merge_nodes(n, best)
    return merge.invariants(n, merged, merge.merge_edges(table(spark, d, "edges"), best))


@query(f"""WITH RECURSIVE {_RESOLVED} SELECT best_id, sum(coalesce(sent, 0))::BIGINT AS sent, sum(coalesce(received, 0))::BIGINT AS received, sum(coalesce(count, 0))::BIGINT AS count, array_to_string(list_sort(list_distinct(flatten(list(coalesce(years, []))))), ',') AS years,
max(coalesce(domain_count, 0)) AS domain_count, array_to_string(list_sort(list(DISTINCT orig_id)), ',') AS aliases FROM best JOIN nodes ON id = orig_id GROUP BY 1""")
def agg12_resolved_nodes(spark, d):
    n = nodes(spark, d)
    return merge.merge_nodes(n, merge.best_ids(resolved(spark, d).state, n)).select(F.col("id").alias("best_id"), "sent", "received", "count", *joined("years"), "domain_count", *joined("aliases"))


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    """The reviewed alias map as a resolved one, ids it lacks standing for themselves."""
    a = table(spark, d, "alias_map").groupBy(F.col("orig_id").alias("id")).agg(F.min("canon").alias("canon"))
    return nodes(spark, d).select("id").join(a, "id", "left").select(F.col("id").alias("orig_id"), F.coalesce("canon", "id").alias("canon"))


_REVIEWED = "rv AS (SELECT id AS orig_id, coalesce(a.canon, id) AS canon FROM nodes LEFT JOIN (SELECT orig_id, min(canon) AS canon FROM alias_map GROUP BY 1) a ON a.orig_id = id)"


@query(f"""WITH {_REVIEWED} SELECT canon AS best_id, sum(coalesce(sent, 0))::BIGINT AS sent, sum(coalesce(received, 0))::BIGINT AS received, sum(coalesce(count, 0))::BIGINT AS count,
array_to_string(list_sort(list_distinct(flatten(list(coalesce(years, []))))), ',') AS years, max(coalesce(domain_count, 0)) AS domain_count, array_to_string(list_sort(list(DISTINCT orig_id)), ',') AS aliases FROM rv JOIN nodes ON id = orig_id GROUP BY canon""")
def agg12_merged_nodes(spark, d):
    best = reviewed(spark, d).withColumnRenamed("canon", "best_id")
    return merge.merge_nodes(nodes(spark, d), best).select(F.col("id").alias("best_id"), "sent", "received", "count", *joined("years"), "domain_count", *joined("aliases"))


@query(f"""WITH {_REVIEWED} SELECT coalesce(s.canon, source) AS source, coalesce(t.canon, target) AS target, sum(coalesce(weight, 1))::BIGINT AS weight, array_to_string(list_sort(list_distinct(flatten(list(coalesce(years, []))))), ',') AS years,
array_to_string(list_sort(list_distinct(flatten(list(coalesce(doc_ids, []))))), ',') AS doc_ids FROM edges LEFT JOIN rv s ON s.orig_id = source LEFT JOIN rv t ON t.orig_id = target WHERE coalesce(s.canon, source) <> coalesce(t.canon, target) GROUP BY 1, 2""")
def agg13_merged_edges(spark, d):
    return merge.merge_edges(table(spark, d, "edges"), reviewed(spark, d).withColumnRenamed("canon", "best_id")).select("source", "target", "weight", *joined("years", "doc_ids"))


_MARKS = lambda ps: " + ".join(f"contains(lower(name), {O.q(p)})::INT" for p in ps)


@query(f"""WITH {_REVIEWED}, f AS (SELECT canon, name, sum(coalesce(count, 1))::BIGINT AS freq FROM rv JOIN nodes ON id = orig_id WHERE name <> '' GROUP BY 1, 2)
SELECT canon, arg_max(name, (len(list_filter(string_split_regex(name, '\\s+'), lambda x: length(x) > 0)) >= 2, name = {O.title('name')}, -({_MARKS(('rn', 'ii', 'ffl', 'ffi', '0', '1', '3'))}), freq, name)) AS name FROM f GROUP BY canon""")
def agg9_best_names(spark, d):
    return resolve.best_names(reviewed(spark, d).join(nodes(spark, d).withColumnRenamed("id", "orig_id"), "orig_id").select("canon", "name", "count"))


@query(f"""WITH {_REVIEWED}, f AS (SELECT canon, name, sum(coalesce(count, 1))::BIGINT AS freq FROM rv JOIN nodes ON id = orig_id WHERE name <> '' GROUP BY 1, 2),
k AS (SELECT *, (len(list_filter(string_split_regex(name, '\\s+'), lambda x: length(x) > 0)) >= 2)::INT AS w, (name = {O.title('name')})::INT AS t, -({_MARKS(('rn', 'ii', 'vv', 'ffl', 'svd', 'liav'))}) AS m FROM f)
SELECT canon, name FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY w DESC, t DESC, freq DESC, m DESC, name) AS r FROM k) WHERE r = 1""")
def agg10_display_names(spark, d):
    return merge.display_name(reviewed(spark, d).join(nodes(spark, d).withColumnRenamed("id", "orig_id"), "orig_id"), "canon")


@query(f"""WITH {_REVIEWED}, k AS (SELECT rv.canon, id, coalesce(count, 0) AS c, (coalesce(domain, '') IN ('epa.gov', 'gmail.com', 'yahoo.com') OR (ends_with(coalesce(domain, ''), '.gov') AND NOT regexp_matches(domain, '[q30]')))::INT AS cl, contains({O.local('id')}, '.')::INT AS dot,
CASE WHEN coalesce(name, '') = '' THEN 0 ELSE (CASE WHEN len(list_filter(string_split_regex(name, '\\s+'), lambda x: length(x) > 0)) >= 2 THEN 2 ELSE 0 END) + (name = {O.title('name')} OR name = upper(name))::INT - regexp_matches(lower(name), 'rn|ii|0|1|3')::INT END AS ql FROM rv JOIN nodes ON id = orig_id)
SELECT canon, id FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY c DESC, cl DESC, dot DESC, ql DESC, length(id), id) AS r FROM k) WHERE r = 1""")
def agg11_canonical_node(spark, d):
    m = reviewed(spark, d).join(nodes(spark, d).withColumn("orig_id", F.col("id")), "orig_id").withColumn("score", merge.node_score())
    return m.join(m.groupBy("canon").agg(F.max("score").alias("score")), ["canon", "score"]).groupBy("canon").agg(F.min("id").alias("id"))


@query(f"""WITH {_REVIEWED} SELECT canon AS best_id, count(*) AS size, array_to_string(list_sort(list(orig_id)), ',') AS aliases FROM rv GROUP BY canon HAVING count(*) > 1 ORDER BY size DESC, best_id LIMIT 100""")
def er9_merge_report(spark, d):
    return merge.merge_report(reviewed(spark, d).withColumnRenamed("canon", "best_id")).select("best_id", "size", *joined("aliases"))


@query("""SELECT 'edges' AS kind, count(*) AS n FROM edges WHERE target NOT IN (SELECT id FROM nodes)""")
def j5_missing_ends(spark, d):
    miss = table(spark, d, "edges").join(nodes(spark, d).select(F.col("id").alias("target")), "target", "left_anti")
    return miss.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "n")


@query("""SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT string_agg(domain || ':' || n, ',' ORDER BY n DESC, domain)
FROM (SELECT domain, count(*) AS n FROM nodes WHERE domain <> '' GROUP BY domain ORDER BY n DESC, domain LIMIT 50)) AS top_domains""")
def agg17_graph_stats(spark, d):
    from epistola.sources.graph import graph_stats

    pairs = F.transform("top_domains", lambda x: F.concat_ws(":", x["domain"], x["count"].cast("string")))
    return graph_stats(nodes(spark, d), table(spark, d, "edges")).select("nodes", "edges", F.array_join(pairs, ",").alias("top_domains"))


def _round_trip(spark: SparkSession, d: str, part: int) -> DataFrame:
    """The graph written as one JSON object to the shared folder and read again."""
    from epistola.sources.graph import read_graph, write_graph

    path = f"{checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}.json"
    write_graph(nodes(spark, d), table(spark, d, "edges"), path)
    return read_graph(spark, path)[part]


@query(f"SELECT id, name, domain, sent, received, count, {s_joined('years')}, domain_count FROM nodes")
def snk1_nodes_round_trip(spark, d):
    return _round_trip(spark, d, 0).select("id", "name", "domain", "sent", "received", "count", *joined("years"), "domain_count")


@query(f"SELECT source, target, weight, {s_joined('years', 'doc_ids')} FROM edges")
def src8_edges_round_trip(spark, d):
    return _round_trip(spark, d, 1).select("source", "target", "weight", *joined("years", "doc_ids"))


# --- cleaning -------------------------------------------------------------------------------------------------------------


def _clean_sql(select: str) -> str:
    """The rules as a chain of CTEs, each with the count of its pattern before it applies, and ``select`` from the last."""
    steps, last = ["c0 AS (SELECT hash_id, text AS was, text, []::BIGINT[] AS n FROM documents)"], "c0"
    for i, (_, p, r, _n) in enumerate(cleaning.RULES, 1):
        p = p.replace("(?Ui)", "(?i)").replace("(?U)", "").replace(r"\w", r"[\pL\pN_]")
        r = r.replace("$1", "\\1").replace("$2", "\\2")
        steps.append(f"c{i} AS MATERIALIZED (SELECT hash_id, was, regexp_replace(text, {O.q(p)}, {O.q(r)}, 'g') AS text, list_append(n, coalesce(len(regexp_extract_all(text, {O.q(p)})), 0)) AS n FROM {last})")
        last = f"c{i}"
    return f"WITH {', '.join(steps)} {select.format(last=last)}"


@query(_clean_sql("SELECT hash_id, md5(text) AS cleaned, list_sum(n)::BIGINT AS total_changes, coalesce(text <> was, false) AS text_changed FROM {last}"))
def cl_clean_text(spark, d):
    return cleaning.clean(docs(spark, d).select("hash_id", "text")).select("hash_id", F.md5("cleaned").alias("cleaned"), "total_changes", "text_changed")


@query(_clean_sql("SELECT fix, sum(k)::BIGINT AS n FROM (SELECT unnest([" + O.listed([r[0] for r in cleaning.RULES]) + "]) AS fix, unnest(n) AS k FROM {last} WHERE text <> was) WHERE k > 0 GROUP BY fix"))
def agg14_fix_totals(spark, d):
    return cleaning.fix_totals(cleaning.clean(docs(spark, d).select("hash_id", "text")))


@query(_clean_sql("SELECT count(*) AS docs_processed, count(*) FILTER (text <> was) AS docs_changed, round(100.0 * count(*) FILTER (text <> was) / nullif(count(*), 0), 6) AS percent FROM {last}"))
def agg15_document_counters(spark, d):
    return cleaning.document_counters(cleaning.clean(docs(spark, d).select("hash_id", "text")))


@query("""WITH t AS (SELECT hash_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS word FROM documents),
v AS (SELECT word AS term FROM t GROUP BY word HAVING count(*) > 20) SELECT word, count(*) AS docs FROM t WHERE word NOT IN (SELECT term FROM v) GROUP BY word""")
def j15_unknown_words(spark, d):
    t = docs(spark, d).select("hash_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)))).alias("word"))
    known = t.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 20").select("word")
    return t.join(known, "word", "left_anti").groupBy("word").agg(F.count(F.lit(1)).alias("docs"))


_FIXES = """t AS (SELECT hash_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]+')), lambda w: regexp_full_match(w, '[a-z]{4,}'))) AS word FROM documents),
v AS (SELECT word AS term, count(*) AS n FROM t GROUP BY word HAVING count(*) > 20), u AS (SELECT DISTINCT word FROM t WHERE word NOT IN (SELECT term FROM v)),
near AS (SELECT word, term FROM (SELECT word, term, row_number() OVER (PARTITION BY word ORDER BY n DESC, term) AS r FROM u JOIN v ON abs(length(word) - length(term)) <= 1 AND levenshtein(word, term) = 1) WHERE r = 1),
fx AS (SELECT hash_id, word, term FROM t JOIN near USING (word))"""


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d).select("hash_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\b[a-z]{4,}\b)"), F.lit(1)))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("count")).where("count > 20")


@query(f"WITH {_FIXES} SELECT hash_id, word, term FROM fx")
def cl10_dictionary_fixes(spark, d):
    return cleaning.dictionary_fixes(docs(spark, d), _dictionary(spark, d), least_count=20)


@query(f"""WITH {_FIXES}, k AS (SELECT hash_id, generate_subscripts(x, 1) AS i, unnest(x) AS w FROM (SELECT hash_id, regexp_extract_all(text, '[\\pL\\pN_]+|[^\\pL\\pN_]+') AS x FROM documents)),
j AS (SELECT hash_id, string_agg(coalesce(term, w), '' ORDER BY i) AS s FROM k LEFT JOIN fx ON fx.hash_id = k.hash_id AND fx.word = lower(w) GROUP BY k.hash_id)
SELECT d.hash_id, md5(CASE WHEN text IS NULL THEN NULL ELSE coalesce(s, '') END) AS corrected FROM documents d LEFT JOIN j USING (hash_id)""".replace("SELECT hash_id, string_agg", "SELECT k.hash_id, string_agg"))
def cl10_corrected_text(spark, d):
    return cleaning.apply_fixes(docs(spark, d).select("hash_id", "text"), _dictionary(spark, d), least_count=20).select("hash_id", F.md5("corrected").alias("corrected"))


# --- search, validation, browsing ---------------------------------------------------------------------------------------------

_ONE, _TWO = "docket.desk@ema.example.org", "rebecca.basiklehofos@yarrow.example.org"
_ALIASES = ["jennifer_nuplehisihos@ridgelab.example.com", "erica.sobupanibrer@yarrow.example.org", "sobupanibrer.erica@yarrow.example.org", "m.bruseniniros@ema.example.org", "no address"]


def _pair_sql(one: str, two: str) -> str:
    return f"""SELECT hash_id, 'https://documents.example.org/' || left(hash_id, 2) || '/' || hash_id || '/' || hash_id || '.pdf' AS url FROM documents WHERE hash_id <> ''
AND regexp_matches(text, '(?i)' || {O.q(one)}) AND regexp_matches(text, '(?i)' || {O.q(two)}) ORDER BY hash_id LIMIT 500"""


@query(_pair_sql(r"docket\.desk@[a-zA-Z0-9._-]*example\.org", r"rebecca\.basiklehofos@[a-zA-Z0-9._-]*example\.org"))
def flt3_pair_search(spark, d):
    return search.correspondence(docs(spark, d), _ONE, _TWO)


@query(_pair_sql(r"docket\.desk@[a-zA-Z0-9._-]*example\.org", r"(jennifer_nuplehisihos@[a-zA-Z0-9._-]*example\.com|erica\.sobupanibrer@[a-zA-Z0-9._-]*example\.org|sobupanibrer\.erica@[a-zA-Z0-9._-]*example\.org|m\.bruseniniros@[a-zA-Z0-9._-]*example\.org)"))
def prj4_alias_search(spark, d):
    """Any of a person's addresses; an alias without an ``@`` matches nothing."""
    return search.correspondence(docs(spark, d), _ONE, _TWO, aliases2=_ALIASES)


@query("SELECT hash_id, 'https://documents.example.org/' || left(hash_id, 2) || '/' || hash_id || '/' || hash_id || '.pdf' AS url FROM documents")
def prj1_document_urls(spark, d):
    return docs(spark, d).select("hash_id", search.document_url().alias("url"))


@query("SELECT source, target, 'bundles/' || least(source, target) || '___' || greatest(source, target) || '.zip' AS key FROM edges")
def prj2_bundle_keys(spark, d):
    return table(spark, d, "edges").select("source", "target", F.concat(F.lit("bundles/"), F.array_join(F.array_sort(F.array("source", "target")), "___"), F.lit(".zip")).alias("key"))


@query("SELECT id AS email, name, count FROM nodes WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), lower(id)))")
def j6_unmatched(spark, d):
    return search.unmatched(nodes(spark, d), docs(spark, d))


_TABLES = ("alias_map", "documents", "domains", "edges", "eval_items", "matches", "messages", "mix_targets", "nodes")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS count FROM {t}" for t in _TABLES))
def src7_collections(spark, d):
    return browse.collections(spark, {t: table(spark, d, t) for t in _TABLES})


@query("SELECT hash_id, original_filename, num_pages FROM documents ORDER BY hash_id LIMIT 20 OFFSET 40")
def src12_page(spark, d):
    return browse.page(docs(spark, d).select("hash_id", "original_filename", "num_pages"), "hash_id", 40, 20)


_FIELDS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"), ("hash_id", "string"), ("year", "int"), ("sender", "string"), ("original_filename", "string"), ("num_pages", "int")]
_KINDS = " UNION ALL ".join(f"SELECT '{n}' AS name, CASE WHEN {n} IS NULL THEN 'null' " + (f"WHEN length({n}) > 100 THEN 'string (' || length({n}) || ' chars)' " if t == "string" else "") + f"ELSE '{t}' END AS type FROM r" for n, t in _FIELDS)


@query(f"WITH r AS (SELECT * FROM documents ORDER BY hash_id LIMIT 1) {_KINDS}")
def src13_describe(spark, d):
    return browse.describe(docs(spark, d), "hash_id")


@query("SELECT hash_id, year FROM documents ORDER BY md5(hash_id || '|42') LIMIT 100")
def src4_sample(spark, d):
    return browse.sample(docs(spark, d).select("hash_id", "year"), 100, key="hash_id")


@query("SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND text <> ''")
def src5_filtered_count(spark, d):
    return docs(spark, d).where("text IS NOT NULL AND text <> ''").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT hash_id FROM documents WHERE hash_id <> '' ORDER BY hash_id LIMIT 500")
def lim1_first_documents(spark, d):
    return docs(spark, d).where("hash_id IS NOT NULL AND hash_id <> ''").select("hash_id").orderBy("hash_id").limit(500)


# --- streaming ----------------------------------------------------------------------------------------------------------------


@query(SQL["agg2_edge_stats"])
def stream_edge_stats(spark, d):
    name = "edges_" + uuid.uuid4().hex
    q = stream.run_to_table(stream.edge_stream(spark, f"{d}/documents.parquet"), name, f"{checkpoint_dir(spark)}/{name}")
    q.awaitTermination()
    return spark.table(name).select("source", "target", "weight", *joined("years", "doc_ids"))


# --- further operators, one by one ------------------------------------------------------------------------------------------------


@query("SELECT domain, count(*) AS count FROM nodes WHERE domain <> '' GROUP BY domain")
def agg7_domain_counts(spark, d):
    return nodes(spark, d).where("domain <> ''").groupBy("domain").agg(F.count(F.lit(1)).alias("count"))


@query(f"WITH {_REVIEWED} SELECT count(DISTINCT canon) AS groups, count(*) AS ids, (SELECT count(*) FROM (SELECT canon FROM rv GROUP BY canon HAVING count(*) > 1)) AS merged_groups FROM rv")
def agg16_group_counts(spark, d):
    sizes = reviewed(spark, d).groupBy("canon").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("ids"), F.count_if(F.col("n") > 1).alias("merged_groups"))


@query("SELECT source, target, weight FROM edges WHERE source <> target")
def flt9_no_self_loops(spark, d):
    return table(spark, d, "edges").where("source <> target").select("source", "target", "weight")


@query("SELECT source, target, weight FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)")
def j5_edges_with_both_ends(spark, d):
    ids, e = nodes(spark, d).select("id"), table(spark, d, "edges")
    for end in ("source", "target"):
        e = e.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return e.select("source", "target", "weight")


@query(f"WITH {_REVIEWED} SELECT orig_id, canon FROM rv")
def j1_remapped_ids(spark, d):
    return reviewed(spark, d)


@query(f"""WITH {_REVIEWED} SELECT canon, array_to_string(list_sort(list(orig_id)), ',') AS originals, sum(coalesce(count, 0))::BIGINT AS total FROM rv JOIN nodes ON id = orig_id GROUP BY canon""")
def j4_group_members(spark, d):
    m = reviewed(spark, d).join(nodes(spark, d).select(F.col("id").alias("orig_id"), "count"), "orig_id")
    return m.groupBy("canon").agg(F.array_join(F.array_sort(F.collect_list("orig_id")), ",").alias("originals"), F.sum(F.coalesce("count", F.lit(0))).alias("total"))


@query("""WITH x AS (SELECT id, split_part(id, '@', 1) AS local, domain FROM nodes WHERE domain IS NOT NULL) SELECT a.id AS id_a, b.id AS id_b, levenshtein(a.domain, b.domain)::BIGINT AS dist FROM x a JOIN x b USING (local)
WHERE a.id < b.id AND a.domain <> b.domain AND levenshtein(a.domain, b.domain) <= greatest(3, greatest(length(a.domain), length(b.domain)) // 3)""")
def j12_same_local_like_domain(spark, d):
    x = nodes(spark, d).where("domain IS NOT NULL").select("id", A.local_of("id").alias("local"), "domain")
    a, b = (x.select("local", F.col("id").alias(f"id_{s}"), F.col("domain").alias(f"domain_{s}")) for s in "ab")
    p = a.join(b, "local").where("id_a < id_b AND domain_a <> domain_b").withColumn("dist", F.levenshtein("domain_a", "domain_b").cast("long"))
    return p.where(F.col("dist") <= F.greatest(F.lit(3), F.expr("greatest(length(domain_a), length(domain_b)) div 3"))).select("id_a", "id_b", "dist")


_KEYED = "k AS (SELECT id, split_part(id, '@', 1) AS local, array_to_string(list_sort(list_filter(string_split_regex(lower(name), '\\s+'), lambda x: length(x) > 0)), ' ') AS key FROM nodes WHERE name <> '')"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    w = F.array_sort(F.filter(F.split(F.lower("name"), r"\s+"), lambda x: F.length(x) > 0))
    return nodes(spark, d).where("name <> ''").select("id", A.local_of("id").alias("local"), F.array_join(w, " ").alias("key"))


@query(f"WITH {_KEYED} SELECT a.id AS id_a, b.id AS id_b FROM k a JOIN k b USING (local, key) WHERE a.id < b.id")
def j13_same_local_and_name(spark, d):
    a, b = (_keyed(spark, d).select("local", "key", F.col("id").alias(f"id_{s}")) for s in "ab")
    return a.join(b, ["local", "key"]).where("id_a < id_b").select("id_a", "id_b")


@query(f"WITH {_KEYED} SELECT a.id AS id_a, b.id AS id_b, levenshtein(a.local, b.local)::BIGINT AS dist FROM k a JOIN k b USING (key) WHERE a.id < b.id AND contains(key, ' ') AND levenshtein(a.local, b.local) <= greatest(2, least(length(a.local), length(b.local)) // 4)")
def j14_same_name_like_local(spark, d):
    a, b = (_keyed(spark, d).where("contains(key, ' ')").select("key", F.col("local").alias(f"local_{s}"), F.col("id").alias(f"id_{s}")) for s in "ab")
    p = a.join(b, "key").where("id_a < id_b").withColumn("dist", F.levenshtein("local_a", "local_b").cast("long"))
    return p.where(F.col("dist") <= F.greatest(F.lit(2), F.expr("least(length(local_a), length(local_b)) div 4"))).select("id_a", "id_b", "dist")


@query("""SELECT id, 'near' AS kind FROM nodes WHERE ends_with(domain, '.gov') AND (length(domain) = 7 AND levenshtein(left(domain, 3), 'epa') <= 1)
UNION ALL SELECT id, 'near' FROM nodes WHERE ends_with(domain, '.gov') AND length(domain) = 8 AND least(levenshtein(substr(domain, 2, 3), 'epa'), levenshtein(left(domain, 1) || substr(domain, 3, 2), 'epa'), levenshtein(left(domain, 2) || substr(domain, 4, 1), 'epa'), levenshtein(left(domain, 3), 'epa')) <= 1""")
def f17_near_agency(spark, d):
    return nodes(spark, d).where("domain IS NOT NULL").where(A.near_agency(F.col("domain"))).select("id", F.lit("near").alias("kind"))


@query("""WITH t AS (SELECT source, target, list_distinct(list_filter(string_split_regex(lower(a.name), '\\s+'), lambda x: length(x) > 0)) AS p, list_distinct(list_filter(string_split_regex(lower(b.name), '\\s+'), lambda x: length(x) > 0)) AS q
FROM (SELECT DISTINCT source, target FROM edges) JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE a.name <> '' AND b.name <> '')
SELECT source, target, len(list_intersect(p, q))::BIGINT AS common, len(list_distinct(list_concat(p, q)))::BIGINT AS either FROM t""")
def set3_name_tokens(spark, d):
    w = nodes(spark, d).where("name <> ''").select("id", F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda x: F.length(x) > 0)).alias("w"))
    e = table(spark, d, "edges").select("source", "target").distinct()
    t = e.join(w.select(F.col("id").alias("source"), F.col("w").alias("p")), "source").join(w.select(F.col("id").alias("target"), F.col("w").alias("q")), "target")
    return t.select("source", "target", F.size(F.array_intersect("p", "q")).cast("long").alias("common"), F.size(F.array_union("p", "q")).cast("long").alias("either"))


@query("SELECT source, array_to_string(list_sort(list_distinct(flatten(list(coalesce(years, []))))), ',') AS years, sum(coalesce(weight, 1))::BIGINT AS weight FROM edges GROUP BY source")
def set2_united_years(spark, d):
    e = table(spark, d, "edges")
    years = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("years", F.expr("cast(array() as array<int>)"))))))
    return e.groupBy("source").agg(F.array_join(years.cast("array<string>"), ",").alias("years"), F.sum(F.coalesce("weight", F.lit(1))).alias("weight"))


@query("SELECT hash_id, coalesce(regexp_extract(lower(text), '[a-z0-9][a-z0-9._-]+@[a-z0-9.-]+\\.(com|net|org|edu|gov|mil|co|io|me|info|biz)'), '') AS first_address, len(regexp_extract_all(text, '[a-z0-9][a-z0-9._-]+@[a-z0-9.-]+\\.(com|net|org|edu|gov|mil|co|io|me|info|biz)', 0, 'i'))::BIGINT AS addresses FROM documents")
def f1_address_scan(spark, d):
    p = rules.ADDRESS
    return docs(spark, d).select("hash_id", F.regexp_extract(F.lower("text"), p, 0).alias("first_address"), F.size(F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(0))).cast("long").alias("addresses"))


_NAMED = f"""nm0 AS (SELECT hash_id, generate_subscripts(regexp_extract_all(text, {O.q(rules.FROM_NAMED)}, 2, 'i'), 1) AS i, lower(unnest(regexp_extract_all(text, {O.q(rules.FROM_NAMED)}, 2, 'i'))) AS a, unnest(regexp_extract_all(text, {O.q(rules.FROM_NAMED)}, 1, 'i')) AS name FROM docs),
nm1 AS (SELECT hash_id, i, {O.build_address('a')} AS email, name, hash_id || '|' || i AS id FROM nm0 WHERE {O.valid('a')} AND length(regexp_replace(name, '^\\s+|\\s+$', '', 'g')) > 1),
nm2 AS (SELECT id, value FROM ({_F8.replace('FROM nodes)', 'FROM nm1)')}) WHERE value IS NOT NULL),
nm3 AS (SELECT hash_id, email, value AS name, row_number() OVER (PARTITION BY hash_id, email ORDER BY i DESC) AS r FROM nm1 JOIN nm2 USING (id)),
shown AS (SELECT email, name FROM (SELECT email, name, row_number() OVER (PARTITION BY email ORDER BY hash_id, name) AS k FROM nm3 WHERE r = 1 AND hash_id IN (SELECT hash_id FROM addr)) WHERE k = 1)"""
SQL["agg3_display_names"] = f"WITH {O.messages()}, {_NAMED} SELECT email, name FROM shown"
_FROM_ADDRESS = f"regexp_replace(regexp_replace({O.local('id')}, '\\.+', '.', 'g'), '^\\.+|\\.+$', '', 'g')"
_NAME_PARTS = f"list_filter(string_split_regex(regexp_replace({_FROM_ADDRESS}, '[._]', ' ', 'g'), '\\s+'), lambda p: length(p) > 0)"
SQL["flt6_export_nodes"] = f"""WITH {O.messages()}, {O.stats()}, {O.mapping()}, {_CONS_NODES}, {_NAMED}, best AS (SELECT coalesce(canon, email) AS id, arg_min(name, email) AS name FROM shown LEFT JOIN vmap USING (email) GROUP BY 1),
made AS (SELECT id, {_NAME_PARTS} AS p, {O.build_domain(O.domain('id'))} = 'epa.gov' AND len({_NAME_PARTS}) = 2 AND len(list_filter({_NAME_PARTS}, lambda p: length(p) > 1 AND regexp_matches(regexp_replace(p, '[-'']', '', 'g'), '^\\p{{L}}+$'))) = 2 AS turn FROM cn)
SELECT cn.id, coalesce(best.name, {O.title("array_to_string(CASE WHEN turn THEN list_reverse(p) ELSE p END, ' ')")}) AS name, {O.domain('cn.id')} AS domain, sent, received, sent + received AS count, len(domains) AS domain_count, {s_joined('years', 'aliases')}
FROM cn JOIN made ON made.id = cn.id LEFT JOIN best ON best.id = cn.id WHERE sent + received >= 2"""


_NEAR = lambda p: f"trim(regexp_extract(text, {O.q(p)} || '\\s*<?\\Q' || {O.local('a')} || '\\E@', 1))"
_GOOD = lambda x: f"length({x}) BETWEEN 1 AND 49 AND NOT regexp_matches({x}, '[@/\\\\]')"


@query(f"""WITH m AS (SELECT DISTINCT hash_id, unnest(from_list) AS a FROM messages), f AS (SELECT hash_id, a, {_NEAR(A.NAME_NEAR[0])} AS x, {_NEAR(A.NAME_NEAR[1])} AS y FROM m JOIN documents USING (hash_id)),
g AS (SELECT hash_id || '|' || a AS id, CASE WHEN {_GOOD('x')} THEN x WHEN {_GOOD('y')} THEN y END AS name FROM f) SELECT id, value FROM ({_F8.replace('FROM nodes)', 'FROM g)')})""")
def f14_name_near(spark, d):
    m = table(spark, d, "messages").select("hash_id", F.explode("from_list").alias("a")).distinct().join(docs(spark, d).select("hash_id", "text"), "hash_id")
    return m.select(F.concat_ws("|", "hash_id", "a").alias("id"), A.name_near(F.col("text"), F.col("a")).alias("value"))
