"""Registered queries against their SQL on DuckDB.

A sample by default; ORACLE_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = [
    "flagship_class_period", "src_header_resolve", "src_missing_columns", "cln_cell_kind_counts", "cln_dedup",
    "unit_to_canonical", "drv_flags", "drv_quality_report", "ftr_build", "spl_by_vessel", "spl_group_kfold",
    "agg_metrics_by_group", "agg_residual_bands", "agg_physics_ols", "agg_wilcoxon", "mdl_predict_interval",
    "ems_totals", "ems_compare", "ems_local_pollutants", "prt_blocking", "prt_shore_power", "tnk_assess", "kpi_assess",
    "flt_score_assignment", "flt_score_plan", "flt_exact_small", "flt_qubo_energy", "par_skyline",
    "par_constrained_rank", "par_hypervolume_3d", "par_igd", "par_crowding", "par_archive_update",
    "src_period_scan", "sink_panel_refresh", "sink_model_card", "ems_notes", "ems_electrification_series", "flt_scenarios",
    "flt_scenario_sweep", "flt_scenario_prices", "flt_objective",
]


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("ORACLE_ALL") else SAMPLE)
def test_query_agrees_with_sql(name, spark, con, small_dir):
    status, note, rows = compare(QUERIES[name](spark, small_dir), con, ORACLES[name])
    assert status == "OK", note
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark, small_dir):
    assert entry.entry(spark).count() > 0
