"""Registered queries against the SQL oracle (a core set; ORACLE=all runs every one)."""

import os

import pytest

import __spark_entry__ as entry
from tests.check import compare, oracle
from tests.conftest import SF

CORE = [
    "ticks_to_bars", "bars_tf", "bar_integrity", "merge_bars", "tail_union", "periods", "bar_subsample", "atr", "ewma_vol", "rsi", "ret_streak",
    "structure", "levels", "candles", "event_asof", "first_touch", "excursions", "dir_first_touch", "big_move", "placement_prior", "quantile_bins",
    "apply_calib", "side_choice", "non_overlap", "loss_classify", "reconcile", "position_state", "microstructure", "stream_bars", "incremental_append",
    "csv_scan", "learned_pair", "live_scan", "spread_sensitivity", "incremental_union", "matrix_rows",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ORACLE") == "all" else CORE


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, oracle(SF, entry.oracle_sql()[name])) == ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
