"""Text cleaning: an ordered fold over the rule array inside Catalyst, with the count of each rule before it applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistola.functions.cleaning_rules import cleaning_rules

RULES = cleaning_rules()


def _fold(text: Column) -> Column:
    """Text and counts after all rules. A rule's pattern runs only where its needle stands in the text, which hardly any does."""
    rules = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.lit(r).alias("r"), F.lit(n).alias("n")) for k, p, r, n in RULES])
    zero = F.struct(text.alias("text"), F.lower(text).alias("low"), F.expr("cast(array() as array<struct<key:string,n:bigint>>)").alias("counts"))

    def step(acc: Column, rule: Column) -> Column:
        hits = F.when(F.contains(acc["low"], rule["n"]), F.regexp_count(acc["text"], rule["p"]).cast("long")).otherwise(0)

        def applied(n: Column) -> Column:
            new = F.regexp_replace(acc["text"], rule["p"], rule["r"])
            return F.when(n > 0, F.struct(new.alias("text"), F.lower(new).alias("low"), F.concat(acc["counts"], F.array(F.struct(rule["k"].alias("key"), n.alias("n")))).alias("counts"))).otherwise(acc)

        return F.transform(F.array(hits), applied)[0]

    return F.aggregate(rules, zero, step)


def clean(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``cleaned``, ``stats`` (map of statistic to count), ``total_changes`` and ``text_changed``. Null text stays null with no changes."""
    done = documents.withColumn("_c", F.when(F.col(text).isNotNull(), _fold(F.col(text))))
    keys = F.array_distinct(F.transform("_c.counts", lambda x: x["key"]))
    total = lambda k: F.aggregate(F.filter("_c.counts", lambda x: x["key"] == k), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    out = done.withColumn("cleaned", F.col("_c.text")).withColumn("stats", F.map_from_arrays(keys, F.transform(keys, total)))
    out = out.withColumn("total_changes", F.coalesce(F.aggregate("_c.counts", F.lit(0).cast("long"), lambda s, x: s + x["n"]), F.lit(0)))
    return out.withColumn("text_changed", F.coalesce(F.col("cleaned") != F.col(text), F.lit(False))).drop("_c")


def fix_totals(cleaned: DataFrame) -> DataFrame:
    """``fix, n``: totals over changed documents, most frequent first."""
    # Not a filter: pushed below, it would run the rules a second time.
    rows = cleaned.select(F.explode(F.when(F.col("text_changed"), F.col("stats"))).alias("fix", "n"))
    return rows.groupBy("fix").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "fix")


def document_counters(cleaned: DataFrame) -> DataFrame:
    """Documents seen and changed, and the share changed (null for none)."""
    return cleaned.agg(F.count(F.lit(1)).alias("docs_processed"), F.count_if("text_changed").alias("docs_changed")).withColumn("percent", F.round(F.try_divide(100 * F.col("docs_changed"), F.col("docs_processed")), 6))


def dictionary_fixes(documents: DataFrame, dictionary: DataFrame, text: str = "text", key: str = "hash_id", least_count: int = 1000) -> DataFrame:
    """``key, word, term, distance``: distinct words of four letters or more, no terms themselves, with a term at edit distance 1 of more than ``least_count``.

    A deletion-neighbourhood join: words and terms meet under each form with one letter taken out; a distance check follows. Of several terms the most frequent, then the first.
    """
    words = documents.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)(\b[a-z]{4,}\b)"), F.lit(1)))).alias("word"))
    terms = dictionary.select(F.lower("term").alias("term"), F.col("count").alias("n"))
    cuts = lambda c: F.array_distinct(F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.lit(64))))))
    distinct = words.select("word").distinct().join(terms.select(F.col("term").alias("word")), "word", "left_anti")
    a = distinct.select("word", F.explode(cuts("word")).alias("cut"))
    b = terms.where(F.col("n") > least_count).select("term", "n", F.explode(cuts("term")).alias("cut"))
    near = a.join(b, "cut").where(F.levenshtein("word", "term") == 1).groupBy("word").agg(F.max_by("term", F.struct("n", F.expr("transform(array(term), x -> translate(x, 'abcdefghijklmnopqrstuvwxyz', 'zyxwvutsrqponmlkjihgfedcba'))[0]"))).alias("term"))
    return words.join(near, "word").select(key, "word", "term")


def apply_fixes(documents: DataFrame, dictionary: DataFrame, text: str = "text", key: str = "hash_id", least_count: int = 1000) -> DataFrame:
    """``documents`` with ``corrected``: every word of ``dictionary_fixes`` replaced by its term wherever it stands whole, in any case (the term is in lower
    case). A null text stays null; of a repeated key the fixes of all its texts apply to each."""
    fixes = dictionary_fixes(documents, dictionary, text, key, least_count).distinct()
    own = fixes.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "term"))).alias("_fixes"))  # bounded by a document's words
    tokens = F.regexp_extract_all(F.col(text), F.lit(r"(?U)(\w+|\W+)"), F.lit(1))
    done = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.element_at("_fixes", F.lower(t)), t)), "")
    return documents.join(own, key, "left").withColumn("corrected", F.when(F.col("_fixes").isNull(), F.col(text)).otherwise(done)).drop("_fixes")
