"""Address and name functions as Column expressions. None of them leaves the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from epistola.functions import rules

C = Column | str


def _col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value bound once, so that chained rules don't multiply the expression."""
    return F.transform(F.array(value), body)[0]


def replaced(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def looked_up(c: Column, table: Mapping[str, str]) -> Column:
    """The table's value for a column, null where it has none; the table is a literal of the plan."""
    if not table:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def has_at(a: C) -> Column:
    return F.contains(_col(a), F.lit("@"))


def local_of(a: C) -> Column:
    return F.split_part(_col(a), F.lit("@"), F.lit(1))


def rest_of(a: C) -> Column:
    """All behind the first ``@``."""
    return F.regexp_extract(_col(a), r"(?s)^[^@]*@(.*)$", 1)


def is_valid(a: C) -> Column:
    """An address with a local part of two characters or more that is not all digits."""
    return has_at(a) & (F.length(local_of(a)) >= 2) & ~local_of(a).rlike(r"^(?U)\d+$")


def domain_of(a: C) -> Column:
    """The lower-case piece between the first ``@`` and the next, empty without one."""
    return F.when(has_at(a), F.lower(F.split_part(_col(a), F.lit("@"), F.lit(2)))).otherwise("")


def build_domain(d: C) -> Column:
    """The domain normaliser of the network build."""

    def ruled(x: Column) -> Column:
        last = F.substring_index(x, ".", -1)
        out = F.when(x.isin(rules.AGENCY_VARIANTS_BUILD), F.lit(rules.AGENCY))
        for k, v in (rules.STATE_AGENCIES_BUILD | rules.BUILD_REPAIRS).items():
            out = out.when(x == k, F.lit(v))
        out = out.when(x.endswith(".govl"), F.regexp_replace(x, "l$", ""))
        return out.when(x.contains(".") & last.isin(*rules.BUILD_ENDINGS), F.concat(F.regexp_extract(x, r"^(.*\.)[^.]*$", 1), F.lit("gov"))).otherwise(x)

    return let(F.regexp_replace(F.trim(F.lower(_col(d))), r"^\.+", ""), ruled)


def build_address(a: C) -> Column:
    """An address with its domain normalised; in ``.gov`` domains hyphens of the local part become dots."""
    d = build_domain(rest_of(a))
    fixed = let(F.struct(local_of(a).alias("l"), d.alias("d")), lambda s: F.concat(F.when(s["d"].endswith(".gov"), F.replace(s["l"], F.lit("-"), F.lit("."))).otherwise(s["l"]), F.lit("@"), s["d"]))
    return F.when(has_at(a), fixed).otherwise(_col(a))


def sorted_local(l: C) -> Column:
    """A local part with its parts of two characters or more in order; unchanged with fewer than two of them."""
    parts = F.filter(F.split(_col(l), r"[._\-]"), lambda p: F.length(p) > 1)
    return let(parts, lambda p: F.when(F.size(p) >= 2, F.array_join(F.array_sort(p), ".")).otherwise(_col(l)))


def canonical_address(a: C) -> Column:
    """The key under which reversed names meet (build stage): lower-case sorted local part at the lower-case domain."""
    parts = F.filter(F.split(F.lower(local_of(a)), r"[._\-]"), lambda p: F.length(p) > 1)
    key = let(parts, lambda p: F.when(F.size(p) >= 2, F.concat(F.array_join(F.array_sort(p), "."), F.lit("@"), F.lower(rest_of(a)))).otherwise(F.lower(_col(a))))
    return F.when(has_at(a), key).otherwise(_col(a))


def title(s: C) -> Column:
    """Capitals after every non-letter, small letters after letters."""
    words = F.regexp_extract_all(_col(s), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20)))), "")


def name_from_address(a: C) -> Column:
    """A display name from the local part; the agency's addresses put the last name first."""
    clean = F.regexp_replace(F.regexp_replace(local_of(a), r"\.+", "."), r"^\.+|\.+$", "")
    parts = F.filter(F.split(F.regexp_replace(clean, "[._]", " "), r"\s+"), lambda p: F.length(p) > 0)
    plain = lambda p: F.regexp_replace(p, "[-']", "").rlike(r"^\p{L}+$") & (F.length(p) > 1)
    turned = lambda p: F.when((build_domain(domain_of(a)) == rules.AGENCY) & (F.size(p) == 2) & plain(F.get(p, F.lit(0))) & plain(F.get(p, F.lit(1))), F.reverse(p)).otherwise(p)
    return title(F.array_join(let(parts, turned), " "))


def repaired_name(n: C) -> Column:
    """A display name put right: header pieces, figures and overlong ones give null, ``Last, First`` is turned, the rest must be one to four words."""
    s = F.regexp_replace(F.regexp_replace(_col(n), r"^\s+|\s+$", ""), "^[\"']+|[\"']+$", "")

    def ruled(x: Column) -> Column:
        low = F.lower(x)
        bad = F.length(x) > 40
        for g in rules.NAME_GARBAGE:
            bad = bad | low.contains(g)
        bad = bad | x.rlike(r"(?U)\d")
        word = lambda w: F.regexp_replace(w, "[.'-]", "").rlike(r"^\p{L}+$")
        sides = F.transform(F.split(x, ",", 2), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
        last, first = F.get(sides, F.lit(0)), F.get(F.split(F.get(sides, F.lit(1)), r"\s+"), F.lit(0))
        tail = F.element_at(F.split(last, r"\s+"), -1)
        turned = x.contains(",") & (F.length(last) > 0) & (F.length(first) > 0) & word(first) & word(tail) & F.length(first).between(2, 20) & F.length(tail).between(2, 20)
        words = F.filter(F.split(x, r"\s+"), lambda w: F.length(w) > 0)
        fine = F.size(words).between(1, 4) & F.forall(words, lambda w: word(w) & (F.length(w) >= 2))
        return F.when(bad, F.lit(None)).when(turned, title(F.concat(first, F.lit(" "), last))).when(fine, title(x))

    return F.when(F.length(_col(n)) > 0, let(s, ruled))


def structural(a: C, repairs: Mapping[str, str] | None = None) -> Column:
    """The first layer: prefix, brackets, stray dots and hyphens. ``repairs``: whole addresses put right at the end."""
    s = F.regexp_replace(F.lower(F.regexp_replace(_col(a), r"^\s+|\s+$", "")), rules.MAILTO, "")
    s = F.regexp_replace(F.regexp_replace(s, r"^[<>]+|[<>]+$", ""), r"^\s+|\s+$", "")

    def ruled(x: Column) -> Column:
        l = F.regexp_replace(F.regexp_replace(F.regexp_replace(local_of(x), r"^\.+|\.+$", ""), "-", "."), r"\.{2,}", ".")
        d = F.regexp_replace(F.regexp_replace(rest_of(x), r"\.{2,}", "."), r"^[.\-]+|[.\-]+$", "")
        return F.when(has_at(x) & (F.length(l) > 0) & (F.length(d) > 0), F.concat(l, F.lit("@"), d)).otherwise(x)

    out = let(s, ruled)
    return let(out, lambda x: F.coalesce(looked_up(x, repairs), x)) if repairs else out


_ROUND = ("reset", "end", "label", "go", "trim")


def match_domain(d: C, repairs: Mapping[str, str] | None = None, characters: bool = True) -> Column:
    """The domain key of the deduplication. ``characters=False`` leaves out the character map, for display."""
    repairs = rules.DOMAIN_REPAIRS if repairs is None else repairs
    variants = [*rules.AGENCY_VARIANTS_BUILD, *rules.AGENCY_VARIANTS_MORE]
    start = F.replace(F.regexp_replace(F.lower(_col(d)), r"^[.\-]+|[.\-]+$", ""), F.lit(" "), F.lit(""))
    fixed = lambda x: F.when(x.isin(variants), F.lit(rules.AGENCY)).otherwise(looked_up(x, repairs))

    def joined(x: Column) -> Column:
        two, three = r"^(.+)\.([^.]{0,2})\.([^.]{0,3})$", r"^(.+)\.([^.]{0,2})\.([^.]{0,2})\.([^.]{0,2})$"
        size = F.length(F.regexp_extract(x, two, 2)) + F.length(F.regexp_extract(x, two, 3))
        size3 = F.length(F.regexp_extract(x, three, 2)) + F.length(F.regexp_extract(x, three, 3)) + F.length(F.regexp_extract(x, three, 4))
        return F.when(x.rlike(two) & (size <= 4), F.regexp_replace(x, two, "$1.$2$3")).when(x.rlike(three) & (size3 <= 5), F.regexp_replace(x, three, "$1.$2$3$4")).otherwise(x)

    def step(s: Column, op: Column) -> Column:
        x, done = s["d"], s["changed"]
        last = F.substring_index(x, ".", -1)
        label = looked_up(last, rules.LAST_LABELS)
        host = F.regexp_extract(x, r"^(.*)\.go$", 1)
        made = (
            F.when((op == "end") & x.rlike(r"\.gov[l1ji]$"), F.regexp_replace(x, ".$", ""))
            .when((op == "label") & x.contains(".") & label.isNotNull(), F.concat(F.regexp_replace(x, r"[^.]*$", ""), label))
            .when((op == "go") & ~done & x.rlike(r"^.+\.go$") & (F.length(F.substring_index(host, ".", -1)) <= 5), F.concat(x, F.lit("v")))
            .when((op == "trim") & ~done & (F.length(x) > 4) & last.rlike("[l1j]$") & ~last.isin("html", "mil"), F.regexp_replace(x, ".$", ""))
            .otherwise(x)
        )
        return F.struct(made.alias("d"), ((op != "reset") & (done | (made != x))).alias("changed"))

    def suffixes(x: Column) -> Column:
        ops = F.array(*[F.lit(o) for _ in range(3) for o in _ROUND])
        return F.aggregate(ops, F.struct(x.alias("d"), F.lit(False).alias("changed")), step, lambda s: s["d"])

    def mapped(x: Column) -> Column:
        head = F.regexp_extract(x, r"^(.*)\.[^.]*$", 1)
        return F.when(x.contains("."), F.concat(replaced(head, rules.DOMAIN_CHARACTERS), F.lit("."), F.substring_index(x, ".", -1))).otherwise(x) if characters else x

    def rest(x: Column) -> Column:
        again = lambda y, more: let(F.struct(y.alias("y"), fixed(y).alias("f")), lambda s: F.coalesce(s["f"], more(s["y"])))
        final = lambda y: F.when(near_agency(y), F.lit(rules.AGENCY)).otherwise(y)
        agency = lambda y, more: let(y, lambda z: F.when(z.isin(variants), F.lit(rules.AGENCY)).otherwise(more(z)))
        return agency(joined(x), lambda y: let(suffixes(y), lambda z: again(z, lambda v: let(mapped(v), lambda m: again(m, final)))))

    return let(start, lambda x: F.when(x.isin(variants), F.lit(rules.AGENCY)).when(x.isin(*rules.STATE_AGENCIES), x).otherwise(F.coalesce(looked_up(x, repairs), rest(x))))


def near_agency(d: Column) -> Column:
    """Whether a ``.gov`` domain is a character away from the agency's, or a character longer than one that is."""
    name = rules.AGENCY.split(".")[0]
    host = F.regexp_extract(d, r"^(.*)\.gov$", 1)
    cut = F.exists(F.sequence(F.lit(1), F.lit(4)), lambda i: F.levenshtein(F.concat(F.substring(host, F.lit(1), i - 1), F.substring(host, i + 1, F.lit(9))), F.lit(name)) <= 1)
    return d.endswith(".gov") & (((F.length(host) == 3) & (F.levenshtein(host, F.lit(name)) <= 1)) | ((F.length(host) == 4) & cut))


def match_local(l: C) -> Column:
    """The local key of the deduplication: character confusions undone one way."""
    return replaced(_col(l), rules.LOCAL_CHARACTERS)


def display_local(l: C) -> Column:
    """A local part repaired for display: figures between letters, and a leading figure before three letters or more."""

    def part(p: Column) -> Column:
        out = p
        for a, b in rules.DISPLAY_INNER:
            out = F.regexp_replace(out, rf"(?<=[a-z]){a}(?=[a-z])", b)
        for a, b in rules.DISPLAY_FIRST:
            out = F.regexp_replace(out, rf"^{a}(?=[a-z]{{3,}})", b)
        return F.when(p.rlike(r"^\d+$"), p).otherwise(out)

    marks = F.regexp_extract_all(_col(l), F.lit(r"([._]|[^._]+)"), F.lit(1))
    return F.array_join(F.transform(marks, part), "")


def with_domain(a: C, f) -> Column:
    """An address with ``f`` applied to all behind its first ``@``."""
    return F.when(has_at(a), F.concat(local_of(a), F.lit("@"), f(rest_of(a)))).otherwise(_col(a))


def with_local(a: C, f) -> Column:
    return F.when(has_at(a), F.concat(f(local_of(a)), F.lit("@"), rest_of(a))).otherwise(_col(a))


def name_near(text: Column, address: Column) -> Column:
    """The name that stands before an address in a text, in quotation marks or behind a header's colon, repaired; null if there is none or it is garbage."""
    mark = F.concat(F.lit("\\s*<?\\Q"), F.split_part(address, F.lit("@"), F.lit(1)), F.lit("\\E@"))
    found = [F.trim(F.call_function("regexp_extract", text, F.concat(F.lit(p), mark), F.lit(1))) for p in NAME_NEAR]
    good = lambda n: (F.length(n) > 0) & (F.length(n) < 50) & ~n.rlike(r"[@/\\\\]")
    return F.when(good(found[0]), repaired_name(found[0])).when(good(found[1]), repaired_name(found[1]))


#: What stands before an address with a name: fixed values.
NAME_NEAR = ("(?i)[\"']([^\"']+)[\"']?", r"(?i)(?:From|To|Cc):\s*([^<\n]+?)")
