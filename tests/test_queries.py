"""Every registered query of the core runs; where it has SQL, DuckDB gives the same rows."""

import pytest

from potamos.plans import registry

from .conftest import SF

#: Run and held against plain Python in test_network_brute_force and test_cells_brute_force.
ELSEWHERE = {
    "o_g01_clean_network", "o_g13_split_interbasin", "o_g16_peel_leaves", "o_g16_pruned_nodes", "o_g26_fill_names", "o_g30_allocate_components", "o_g31_agglomerate_domains", "o_g31_agglomerate_by_product",
    "o_g32_grow_within_distance", "o_g32_grow_largest", "o_g32_grow_most_compact", "o_r01_fill_river_mask", "o_r01_clumps", "o_r01_fill_small_bars", "o_r02_extend_coast", "o_r04_patch_tidal_clumps", "o_r05_skeleton",
    "o_r10_fill_depressions", "o_r10_sinks", "o_r13_class_changes", "o_r18_catchments", "o_r18_catchment_table",
}


def test_only_queries_without_sql_are_run_elsewhere():
    assert ELSEWHERE <= set(registry.queries()) - set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - ELSEWHERE))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted(tuple(repr(r[k]) for k in at) for r in found.fetchall()) == rows
