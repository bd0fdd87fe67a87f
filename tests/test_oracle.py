"""Registered queries beside their SQL on the smallest tables (``tests/oracle.py`` runs all of them)."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "P7_valid_depth", "P13_cap_even", "P15_normalize_depth", "A8_lift_report", "A10_mad_filter", "A12_build_detections", "robust_box_per_cloud",
    "P1_valid_shape", "P3_normalize_polygon", "A1_instance_counts", "J9_promote", "J10_mask_overlap", "A20_qc_report", "U4_split_dataset",
    "W1_track_window", "W3_stability", "J12_asof_pose", "T5_publish_stats", "T6_asof_pose_stream", "M4_render_views", "M7_close_mask",
    "M11_lift_captures", "A22_evaluate_boxes", "A13_calibration_spread", "W6_unwrap", "T9_arbitrate", "S8_explode_depth",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, contract.queries()[name], contract.oracle_sql()[name], SF) is None


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 150


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
