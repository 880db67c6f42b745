"""The queries of the training-data operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epistola.llm import components, langid, leak, mailtext, mixing, names, neardup, ocr, survivor
from epistola.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(table(spark, d, "nodes"), table(spark, d, "domains"), table(spark, d, "alias_map"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return names.name_groups(table(spark, d, "nodes"), table(spark, d, "domains"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mailtext.new_lines(table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.consolidate_matches(table(spark, d, "matches"), table(spark, d, "nodes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.repair_places(table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "alias_map"), table(spark, d, "nodes"), table(spark, d, "domains"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "documents"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_plan(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).copies()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.wrong_labels(table(spark, d, "documents"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return langid.label_documents(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_groups": p6_groups, "p7_found": p7_found, "p8_plan": p8_plan, "p8_shares": p8_shares, "p9_found": p9_found, "p9_documents": p9_documents}

SQL = {
    "p3_found": """
WITH RECURSIVE m AS (
  SELECT DISTINCT src, dst FROM matches
  WHERE src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)
), e AS (SELECT src AS a, dst AS b FROM m UNION SELECT dst, src FROM m),
r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT id, min(seen) AS group_id FROM r GROUP BY id""",
}
