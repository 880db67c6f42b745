import os

import duckdb
import pytest

import __spark_entry__
from epistola.plans import registry

CHECKED = ["agg2_edge_stats", "agg1_node_stats", "agg5_consolidated_nodes", "f16_match_domain", "er3b_split_locals", "er3c_stripped_prefixes", "j7_fuzzy_pairs", "gr1_components", "er0_follow_chains", "agg13_merged_edges", "j6_unmatched", "stream_edge_stats", "f23_jaro_winkler", "er4_fuzzy_merges", "er7_same_name", "er_alias_map", "cl10_corrected_text", "prj4_alias_search", "f14_name_near", "src13_describe", "src8_edges_round_trip"]


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    got = registry.QUERIES[name](spark, small)
    cols = sorted(got.columns)
    key = lambda r: tuple(str(x) for x in r)
    a = sorted(map(key, got.select(cols).collect()))
    b = sorted(map(key, con.execute(f"SELECT {', '.join(cols)} FROM ({registry.SQL[name]})").fetchall()))
    assert a == b


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
