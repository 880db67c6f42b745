"""Mail headers out of document texts, as Column expressions: one row per mail with its senders, recipients and display names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistola.functions import address as A
from epistola.functions import rules


def header_filter(text: str = "text") -> Column:
    """Texts with a ``From:`` and a ``To:`` that have an ``@`` behind them on their line, in any case."""
    return F.col(text).rlike("(?i)From:.*@") & F.col(text).rlike("(?i)To:.*@")


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit("(?Ui)" + pattern), F.lit(group))


def _lines(text: Column, pattern: str) -> Column:
    """Addresses anywhere in the rest of a header's lines; the header's own case counts."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit("(?i)" + rules.ADDRESS), F.lit(0))))


def _addresses(found: Column) -> Column:
    """Distinct valid addresses of an array, lower-case and normalised, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.transform(found, F.lower), A.is_valid), A.build_address)))


def parse_messages(documents: DataFrame, keep: tuple[str, ...] = ("hash_id", "year")) -> DataFrame:
    """``keep`` columns plus ``from_list, to_list, cc_list`` (sorted sets) and ``display_names`` (last valid name per address). Texts without sender and recipient are
    left out; copies alone make no message."""
    t = F.col("text")
    senders = F.concat(_found(t, rules.FROM_NAMED, 2), *[_found(t, p, 1) for p in rules.FROM_BARE])
    to = F.concat(*[_found(t, p, 2) for p in rules.TO_NAMED], _lines(t, rules.TO_LINE))
    cc = F.concat(_found(t, rules.CC_NAMED, 2), _lines(t, rules.CC_LINE))
    named = F.arrays_zip(_found(t, rules.FROM_NAMED, 2).alias("a"), _found(t, rules.FROM_NAMED, 1).alias("n"))
    pairs = F.transform(named, lambda z: F.struct(F.lower(z["a"]).alias("a"), F.when(F.length(F.regexp_replace(z["n"], r"^\s+|\s+$", "")) > 1, A.repaired_name(z["n"])).alias("n")))
    pairs = F.transform(F.filter(pairs, lambda z: z["n"].isNotNull() & A.is_valid(z["a"])), lambda z: F.struct(A.build_address(z["a"]).alias("a"), z["n"].alias("n")))
    # Of several names of one address the last in the text holds.
    last = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, z: F.map_concat(F.map_filter(m, lambda k, _: k != z["a"]), F.map_from_arrays(F.array(z["a"]), F.array(z["n"]))))
    parsed = documents.where(F.col("text").isNotNull()).select(*keep, _addresses(senders).alias("from_list"), _addresses(to).alias("to_list"), _addresses(cc).alias("cc_list"), last.alias("display_names"))
    return parsed.where((F.size("from_list") > 0) | (F.size("to_list") > 0))
