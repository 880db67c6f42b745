import pytest
from pyspark.sql import functions as F

from epistola.functions import address as A
from epistola.functions.similarity import jaro_winkler, parts_distance
from epistola.operators import merge


def value(spark, expr, x):
    return spark.createDataFrame([(x,)], "x string").select(expr.alias("v")).first().v


CASES = [
    (A.canonical_address, "john.q.public@x.org", "john.public@x.org"),
    (A.canonical_address, "Stone-Ana@X.org", "ana.stone@x.org"),
    (A.sorted_local, "a.stone", "a.stone"),
    (A.sorted_local, "john.q.public", "john.public"),
    (A.match_local, "bernard.stone", "bemard.stone"),
    (A.match_local, "iiii", "nn"),
    (A.structural, "mailto:Stone-Ana..@epa..gov.", "stone.ana@epa.gov"),
    (A.structural, "plain", "plain"),
    (A.display_local, "st0ne.de1ia", "stone.delia"),
    (A.display_local, "3van.123", "evan.123"),
    (A.display_local, "h8le.x9y", "hble.x9y"),
    (A.title, "o'brien smith-jones", "O'Brien Smith-Jones"),
    (A.repaired_name, "Stone, Ana", "Ana Stone"),
    (A.repaired_name, "Mayer Ana", None),
    (A.repaired_name, "Ana 2 Stone", None),
    (A.repaired_name, "", None),
    (A.name_from_address, "stone.ana@epa.gov", "Ana Stone"),
    (A.name_from_address, "stone.ana@x.org", "Stone Ana"),
    (A.build_domain, "epa.qov", "epa.gov"),
    (A.build_domain, ".x.goy", "x.gov"),
    (A.build_domain, "x.govl", "x.gov"),
    (A.build_domain, "ilepa.gov", "iepa.gov"),
    (A.match_domain, "x.co.uk", "x.couk"),
    (A.match_domain, "firm.nl", "firm.n"),
    (A.match_domain, "venus.com", "yenus.com"),
    (A.match_domain, "eia.gov", "epa.gov"),
    (A.match_domain, "fema.gov", "epa.gov"),
    (A.match_domain, "nasa.gov", "nasa.gov"),
    (A.match_domain, "north.example.corn", "north.example.com"),
    (A.match_domain, "ridge.example.orql", "ridge.example.org"),
    (A.domain_of, "a@b@c", "b"),
    (A.build_address, "a-b@x.gov", "a.b@x.gov"),
]


@pytest.mark.parametrize("f,x,want", CASES, ids=[f"{f.__name__}:{x}" for f, x, _ in CASES])
def test_function(spark, f, x, want):
    assert value(spark, f("x"), x) == want
    assert value(spark, f("x"), None) in (None, "")


@pytest.mark.parametrize("x,want", [("ab@x.org", True), ("a@x.org", False), ("12@x.org", False), ("ab", False)])
def test_valid(spark, x, want):
    assert bool(value(spark, A.is_valid("x"), x)) is want


def test_names_from_ids(spark):
    assert value(spark, merge.name_from_id(F.col("x")), "hale.bo@x.org") == "Hale Bo"
    assert value(spark, merge.name_from_id(F.col("x")), "jgreen@x.org") == "J. Green"
    assert value(spark, merge.name_from_id(F.col("x")), "info@x.org") == ""
    assert value(spark, merge.fixed_order(F.lit("Stone Ana"), F.col("x"), F.lit("epa.gov")), "stone.ana@epa.gov") == "Ana Stone"


def test_similarities():
    assert round(jaro_winkler("martha", "marhta"), 6) == 0.961111
    assert round(jaro_winkler("dixon", "dicksonx"), 6) == 0.813333
    assert jaro_winkler("", "a") == 0.0
    assert parts_distance(["ana", "stone"], ["stone", "anna"]) == 1
    assert parts_distance(list("abcdefgh"), list("hgfedcba")) == 0
