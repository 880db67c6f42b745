"""DuckDB SQL pieces that the registry's oracle statements are put together from."""

from __future__ import annotations

from collections.abc import Sequence

from epistola.functions import rules


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(xs: Sequence[str]) -> str:
    return ", ".join(q(x) for x in xs)


def replaced(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def local(a: str) -> str:
    return f"split_part({a}, '@', 1)"


def rest(a: str) -> str:
    return f"substr({a}, strpos({a}, '@') + 1)"


def valid(a: str) -> str:
    return f"(contains({a}, '@') AND length({local(a)}) >= 2 AND NOT regexp_matches({local(a)}, '^[0-9]+$'))"


def domain(a: str) -> str:
    return f"CASE WHEN contains({a}, '@') THEN lower(split_part({a}, '@', 2)) ELSE '' END"


def build_domain(d: str) -> str:
    x = f"regexp_replace(trim(lower({d})), '^\\.+', '')"
    fixed = "".join(f" WHEN {x} = {q(k)} THEN {q(v)}" for k, v in (rules.STATE_AGENCIES_BUILD | rules.BUILD_REPAIRS).items())
    ends = "|".join(rules.BUILD_ENDINGS)
    return f"CASE WHEN {x} IN ({listed(rules.AGENCY_VARIANTS_BUILD)}) THEN {q(rules.AGENCY)}{fixed} WHEN ends_with({x}, '.govl') THEN left({x}, length({x}) - 1) WHEN regexp_matches({x}, '\\.({ends})$') THEN left({x}, length({x}) - 3) || 'gov' ELSE {x} END"


def build_address(a: str) -> str:
    d = f"({build_domain(rest(a))})"
    return f"CASE WHEN contains({a}, '@') THEN (CASE WHEN ends_with({d}, '.gov') THEN replace({local(a)}, '-', '.') ELSE {local(a)} END) || '@' || {d} ELSE {a} END"


def parts(l: str, least: int = 2) -> str:
    return f"list_filter(string_split_regex({l}, '[._\\-]'), lambda p: length(p) >= {least})"


def sorted_local(l: str) -> str:
    return f"CASE WHEN len({parts(l)}) >= 2 THEN array_to_string(list_sort({parts(l)}), '.') ELSE {l} END"


def canonical(a: str) -> str:
    p = parts(f"lower({local(a)})")
    return f"CASE WHEN NOT contains({a}, '@') THEN {a} WHEN len({p}) >= 2 THEN array_to_string(list_sort({p}), '.') || '@' || lower({rest(a)}) ELSE lower({a}) END"


def title(s: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({s}, '\\p{{L}}+|\\P{{L}}+'), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '')"


def structural(a: str) -> str:
    """As a subquery's column ``s`` of a relation with column ``a``: see ``STRUCTURAL``."""
    return f"regexp_replace(regexp_replace(lower(trim({a})), {q(rules.MAILTO.replace('(?:', '('))}, ''), '^[<>]+|[<>]+$', '', 'g')"


def cleaned(a: str) -> str:
    s = structural(a)
    l = f"regexp_replace(replace(regexp_replace({local(s)}, '^\\.+|\\.+$', '', 'g'), '-', '.'), '\\.{{2,}}', '.', 'g')"
    d = f"regexp_replace(regexp_replace({rest(s)}, '\\.{{2,}}', '.', 'g'), '^[.\\-]+|[.\\-]+$', '', 'g')"
    return f"CASE WHEN contains({s}, '@') AND length({l}) > 0 AND length({d}) > 0 THEN {l} || '@' || {d} ELSE {s} END"


def match_domain(source: str, key: str, column: str, characters: bool = True) -> str:
    """A chain of CTEs from relation ``source`` with ``key`` and ``column`` (a domain) to ``matched(key, d)``."""
    variants = listed([*rules.AGENCY_VARIANTS_BUILD, *rules.AGENCY_VARIANTS_MORE])
    repairs = "(VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in rules.DOMAIN_REPAIRS.items()) + ") AS r(bad, good)"
    labels = "".join(f" WHEN {q(k)} THEN {q(v)}" for k, v in rules.LAST_LABELS.items())
    agency = q(rules.AGENCY)
    fix = lambda x: f"CASE WHEN {x} IN ({variants}) THEN {agency} ELSE (SELECT good FROM {repairs} WHERE bad = {x}) END"
    last = lambda x: f"regexp_extract({x}, '[^.]*$')"
    ctes = [
        f"m0 AS (SELECT {key}, replace(regexp_replace(lower({column}), '^[.\\-]+|[.\\-]+$', '', 'g'), ' ', '') AS d FROM {source})",
        f"m1 AS (SELECT {key}, d, CASE WHEN d IN ({variants}) THEN {agency} WHEN d IN ({listed(rules.STATE_AGENCIES)}) THEN d ELSE {fix('d')} END AS fin FROM m0)",
        f"""m2 AS (SELECT {key}, fin, CASE WHEN regexp_matches(d, '^.+\\.[^.]{{0,2}}\\.[^.]{{0,3}}$') AND length(regexp_extract(d, '\\.([^.]{{0,2}})\\.([^.]{{0,3}})$', 1)) + length(regexp_extract(d, '\\.([^.]{{0,2}})\\.([^.]{{0,3}})$', 2)) <= 4
          THEN regexp_replace(d, '\\.([^.]{{0,2}})\\.([^.]{{0,3}})$', '.\\1\\2')
          WHEN regexp_matches(d, '^.+\\.[^.]{{0,2}}\\.[^.]{{0,2}}\\.[^.]{{0,2}}$') AND length(replace(regexp_extract(d, '\\.[^.]{{0,2}}\\.[^.]{{0,2}}\\.[^.]{{0,2}}$'), '.', '')) <= 5 THEN regexp_replace(d, '\\.([^.]{{0,2}})\\.([^.]{{0,2}})\\.([^.]{{0,2}})$', '.\\1\\2\\3') ELSE d END AS d FROM m1)""",
        f"m3 AS (SELECT {key}, CASE WHEN fin IS NULL AND d IN ({variants}) THEN {agency} ELSE fin END AS fin, d FROM m2)",
    ]
    prev = "m3"
    for i in range(3):
        a, b, c, e = (f"m4{x}{i}" for x in "abce")
        ctes.append(f"{a} AS (SELECT {key}, fin, d AS d0, CASE WHEN regexp_matches(d, '\\.gov[l1ji]$') THEN left(d, length(d) - 1) ELSE d END AS d FROM {prev})")
        ctes.append(f"{b} AS (SELECT {key}, fin, d0, CASE WHEN contains(d, '.') AND (CASE {last('d')}{labels} END) IS NOT NULL THEN regexp_replace(d, '[^.]*$', '') || (CASE {last('d')}{labels} END) ELSE d END AS d FROM {a})")
        ctes.append(f"{c} AS (SELECT {key}, fin, d0, CASE WHEN d = d0 AND regexp_matches(d, '^.+\\.go$') AND length({last('left(d, length(d) - 3)')}) <= 5 THEN d || 'v' ELSE d END AS d FROM {b})")
        ctes.append(f"{e} AS (SELECT {key}, fin, CASE WHEN d = d0 AND length(d) > 4 AND regexp_matches({last('d')}, '[l1j]$') AND {last('d')} NOT IN ('html', 'mil') THEN left(d, length(d) - 1) ELSE d END AS d FROM {c})")
        prev = e
    head = replaced("regexp_extract(d, '^(.*)\\.[^.]*$', 1)", rules.DOMAIN_CHARACTERS)
    mapped = f"CASE WHEN contains(d, '.') THEN {head} || '.' || {last('d')} ELSE d END" if characters else "d"
    host = "left(d, length(d) - 4)"
    cut = " OR ".join(f"levenshtein(left({host}, {i}) || substr({host}, {i + 2}), 'epa') <= 1" for i in range(4))
    ctes += [
        f"m5 AS (SELECT {key}, coalesce(fin, {fix('d')}) AS fin, d FROM {prev})",
        f"m6 AS (SELECT {key}, fin, {mapped} AS d FROM m5)",
        f"m7 AS (SELECT {key}, coalesce(fin, {fix('d')}) AS fin, d FROM m6)",
        f"matched AS (SELECT {key}, coalesce(fin, CASE WHEN ends_with(d, '.gov') AND ((length({host}) = 3 AND levenshtein({host}, 'epa') <= 1) OR (length({host}) = 4 AND ({cut}))) THEN {agency} ELSE d END) AS d FROM m7)",
    ]
    return ",\n".join(ctes)


def messages() -> str:
    """CTEs up to ``addr(hash_id, year, kind, a)``: distinct normalised addresses per message, kinds f, t and c; and ``docs``."""
    ex = lambda p, g: f"regexp_extract_all(text, {q(p)}, {g}, 'i')"
    lines = lambda p: f"list_concat([]::VARCHAR[], flatten(list_transform(regexp_extract_all(text, {q(p)}, 1), lambda x: regexp_extract_all(x, {q(rules.ADDRESS)}, 0, 'i'))))"
    f = f"list_concat({ex(rules.FROM_NAMED, 2)}, list_concat({ex(rules.FROM_BARE[0], 1)}, {ex(rules.FROM_BARE[1], 1)}))"
    t = f"list_concat({ex(rules.TO_NAMED[0], 2)}, list_concat({ex(rules.TO_NAMED[1], 2)}, {lines(rules.TO_LINE)}))"
    c = f"list_concat({ex(rules.CC_NAMED, 2)}, {lines(rules.CC_LINE)})"
    return f"""docs AS (SELECT hash_id, year, text FROM documents WHERE regexp_matches(text, '(?i)From:.*@') AND regexp_matches(text, '(?i)To:.*@')),
raw AS (SELECT hash_id, year, 'f' AS kind, lower(unnest({f})) AS a FROM docs UNION ALL SELECT hash_id, year, 't', lower(unnest({t})) FROM docs UNION ALL SELECT hash_id, year, 'c', lower(unnest({c})) FROM docs),
addr0 AS (SELECT DISTINCT hash_id, year, kind, {build_address('a')} AS a FROM raw WHERE {valid('a')}),
addr AS (SELECT * FROM addr0 WHERE hash_id IN (SELECT hash_id FROM addr0 WHERE kind IN ('f', 't'))),
sender AS (SELECT hash_id, year, a FROM addr WHERE kind = 'f'),
rcpt AS (SELECT DISTINCT hash_id, year, a FROM addr WHERE kind IN ('t', 'c'))"""


def stats() -> str:
    """CTEs ``nodes0`` and ``edges0`` on top of ``messages``, arrays sorted."""
    return f"""sent AS (SELECT s.a AS email, s.hash_id, s.year, count(r.a) AS n FROM sender s LEFT JOIN rcpt r USING (hash_id) GROUP BY ALL),
doms AS (SELECT s.a AS email, list_sort(list(DISTINCT {domain('r.a')})) AS domains FROM sender s JOIN rcpt r USING (hash_id) GROUP BY 1),
act AS (SELECT email, n AS sent, 0 AS received, year FROM sent UNION ALL SELECT a, 0, 1, year FROM rcpt),
nodes0 AS (SELECT email, sum(sent)::BIGINT AS sent, sum(received)::BIGINT AS received, list_sort(coalesce(list(DISTINCT year) FILTER (year IS NOT NULL AND year <> 0), [])) AS years, coalesce(any_value(domains), []) AS domains FROM act LEFT JOIN doms USING (email) GROUP BY email),
pair0 AS (SELECT s.hash_id, s.year, s.a AS source, r.a AS target FROM sender s JOIN rcpt r USING (hash_id) WHERE s.a <> r.a),
edges0 AS (SELECT source, target, count(*) AS weight, list_sort(coalesce(list(DISTINCT year) FILTER (year IS NOT NULL AND year <> 0), [])) AS years, list_sort(coalesce(list(DISTINCT hash_id) FILTER (hash_id <> ''), [])) AS doc_ids FROM pair0 GROUP BY 1, 2)"""


def mapping() -> str:
    return f"keyed AS (SELECT email, {canonical('email')} AS key FROM nodes0), vmap AS (SELECT email, min(email) OVER (PARTITION BY key) AS canon FROM keyed)"


def jaro_winkler(pairs: str) -> str:
    """CTEs from ``pairs(k, a, b)`` to ``jw(k, jw)``: characters of a matched from left to right with the first free equal one of b within the window; half
    transpositions kept, a prefix of four at most. Needs ``WITH RECURSIVE``."""
    window = "greatest(greatest(length(a), length(b)) // 2 - 1, 0)"
    return f"""jw0 AS (SELECT k, a, b, 1::BIGINT AS i, []::BIGINT[] AS mine, []::BIGINT[] AS theirs FROM {pairs} UNION ALL
SELECT k, a, b, i + 1, CASE WHEN j IS NULL THEN mine ELSE list_append(mine, i) END, CASE WHEN j IS NULL THEN theirs ELSE list_append(theirs, j) END FROM (
 SELECT *, list_min(list_filter(range(greatest(1, i - {window}), least(length(b), i + {window}) + 1), lambda x: substr(b, x, 1) = substr(a, i, 1) AND NOT list_contains(theirs, x))) AS j FROM jw0 WHERE i <= length(a))),
jw1 AS (SELECT k, a, b, len(mine)::DOUBLE AS m, list_sum(list_transform(list_zip(mine, list_sort(theirs)), lambda z: (substr(a, z[1], 1) <> substr(b, z[2], 1))::INT)) / 2.0 AS half FROM jw0 WHERE i = length(a) + 1),
jw2 AS (SELECT k, a, b, CASE WHEN m = 0 THEN 0 ELSE (m / length(a) + m / length(b) + (m - half) / m) / 3 END AS jaro,
 CASE WHEN left(a, 1) <> left(b, 1) OR a = '' OR b = '' THEN 0 WHEN substr(a, 2, 1) <> substr(b, 2, 1) OR least(length(a), length(b)) < 2 THEN 1 WHEN substr(a, 3, 1) <> substr(b, 3, 1) OR least(length(a), length(b)) < 3 THEN 2 WHEN substr(a, 4, 1) <> substr(b, 4, 1) OR least(length(a), length(b)) < 4 THEN 3 ELSE 4 END AS pre FROM jw1),
jw AS (SELECT k, CASE WHEN a = b THEN 1.0 ELSE jaro + CASE WHEN jaro > 0 THEN pre ELSE 0 END * 0.1 * (1 - jaro) END AS jw FROM jw2)"""
