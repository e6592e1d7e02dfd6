"""Every named query against its SQL in DuckDB, on the smallest tables where it has rows; none may be empty."""

import duckdb
import pytest

from weftgraph.plans import registry

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()
#: Patterns that have no match among 6,000 lineitems; they are asked of ten times as many.
RARE = {
    "a10_duplicates_of", "a1_fan_out", "a20_dedup_ratio", "a2_fan_in", "cy_fan_out", "cy_trails", "documents_exact_duplicates", "h1_variable_timeline",
    "h4_variable_search", "h5_impact_of_retired", "h6_node_search", "h7_member_access", "j13_calls_both", "j16_two_cycles", "j17_three_cycles",
    "j17_three_cycles_ordered", "j18_batch_lookup", "j20_resolve", "j21_file_members", "j23_usages", "j24_function_detail", "j2_in_edges",
    "j30_feeds_by_line", "j3_both", "j8_arguments", "j9_line_ranges", "o3_top_fan_out", "s12_line_chunks", "s14_key_lookup", "s15_definition", "s5_page",
    "t12_consumers", "t15_flow_steps", "t16_flow_paths", "t17_trails", "t18_shortest", "t18_shortest_chains", "t19_all_paths", "t1_reach", "t1_reach_deep", "t20_reverse_reach",
    "t21_deepest", "t6_call_chain_nodes", "t9_timeline_pack",
}


@pytest.fixture(scope="module")
def ducks():
    """A connection for each size of the tables."""
    found = {}
    for sf in (SMALL, LARGER):
        found[sf] = duckdb.connect()
        for t in TABLES:
            found[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return found


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, ducks, name):
    sf = LARGER if name in RARE else SMALL
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = ducks[sf].sql(sql)
    assert sorted(found.columns) == columns
    places = [list(found.columns).index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in places]) for r in found.fetchall())
