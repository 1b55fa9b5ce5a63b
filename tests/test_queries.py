"""Registered queries against their SQL twins on the smallest tables, with blocks that cut tracks."""

import importlib

import pytest

from strideframe.plans import load_all
from strideframe.plans.registry import ORACLES, QUERIES

load_all()

SAMPLE = [
    "bout_scorecard", "g1_label_segments", "g2_bridged_bouts", "g4_short_gap_fill", "g7_moving_activity", "g13_linear_phase", "g18_minimum_run", "g18_bridge_and_drop",
    "g19_behaviour_classes", "g31_run_windows", "d5_spike_repair", "g3_spline_gaps", "g5_savgol", "g6_gaussian_smooth", "g12_frame_cycles", "g21_contact_correction",
    "f25_cycle_table", "e3_nearest_sample", "g25_resample", "g27_loop_resample", "i1_merged_framesets", "f21_mix_weights",
]
BLOCKED = ["series", "filters", "walking", "motion", "joining", "quality"]


@pytest.fixture(scope="module")
def con(sf):
    from oracle_check import connect

    return connect(sf)


@pytest.fixture
def small_blocks(monkeypatch):
    for m in BLOCKED:
        monkeypatch.setattr(importlib.import_module(f"strideframe.plans.{m}"), "BLK", 7)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf, con, small_blocks, name):
    from oracle_check import compare

    assert compare(QUERIES[name](spark, sf), ORACLES[name], con) == ""


def test_every_twin_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["track", "bout", "start_frame", "end_frame", "n_frames", "missing_fraction", "status"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
