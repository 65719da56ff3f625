"""Registered queries against their SQL twins on the smallest tables.

A cross-section runs by default; ALL_TWINS=1 runs every one.
"""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, compare

SF = os.environ.get("TWIN_SF", "/root/testdata/sf0.001")
SOME = [
    "read_scenario_db", "quantile_by_group", "interpolate_gaps", "interpolate_gaps_ticks", "gross_emissions",
    "sustainability_filters", "harmonise_diagnostics", "domain_check", "boxplot_stats", "rpt_sr15_cross_sector",
    "rpt_compare_filters_total", "rpt_key_variables_filtered", "rpt_afforestation_test", "rpt_kyoto_gases",
    "rpt_external_comparison", "rpt_removal_ratio", "rpt_harmonised_long", "rpt_sr15_quantiles", "rpt_final_energy",
    "rpt_key_variables_c1", "boxplot_outliers", "welch_t_test", "pearson_cor_test", "rpt_focal_vs_median", "scan_wide_csv",
    "rpt_benchmark_harmonised", "domain_check_table",
]
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("ALL_TWINS") else SOME)
def test_query_equals_twin(spark, con, name):
    _, state = compare(spark, con, name, entry.queries()[name], SF, entry.oracle_sql().get(name))
    assert state.startswith(("ok", "rows only")), state


def test_every_query_has_a_twin():
    from workload.registry import QUERIES, TWINS

    assert set(QUERIES) == set(TWINS) and set(QUERIES) <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())


def test_zero_as_gap_runs_over_the_whole_table(spark, con):
    _, state = compare(spark, con, "interp_zero_as_gap", entry.queries()["interp_zero_as_gap"], SF,
                       entry.oracle_sql()["interp_zero_as_gap"])
    assert state.startswith("ok"), state
    got = entry.queries()["interp_zero_as_gap"](spark, SF)
    reported = entry.queries()["unpivot_years"](spark, SF).where("year between 2020 and 2050 and value != 0")
    keys = ("scen_id", "Variable")
    want = {tuple(r) for r in reported.select(*keys).distinct().collect()}
    assert {tuple(r) for r in got.select(*keys).distinct().collect()} == want
    assert len({v for _, v in want}) == 30
