"""Registered queries against their SQL on the smallest tables, a sample of every module."""

from __future__ import annotations

import pytest

import compare
from fieldlens.queries import load

FOLDER = "/root/testdata/sf0.001"
CHECKED = """camera_band_board axis_rates camera_board light_window live_day_summary band_estimates matched_evidence
evidence_confidence journal_summary rating_spearman wind_forecast_accuracy stand_pressure wind_climatology wind_median_speed
movement_by_temperature individual_factor_means photo_visits photo_visit_assignment detections_with_weather
empty_baseline_photos photo_labels claims_to_agree camera_quota camera_health counter_gaps counter_gap_summary burst_crossings
visit_headings empty_scene_matches harvest_states rotation_prior crop_verdicts zonal_ndvi reference_radius stands_near_cameras
ground_clusters ground_of_points home_parcels camera_sees_points scent_hits track_against_route terrain_slope_aspect
terrain_flow_accumulation contour_pieces_by_level sit_scores stand_ranking merge_cameras apply_patches camera_ingest
document_blanks position_audit sun_times light_bands season_phases difference_hashes stream_first_seen""".split()


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, name):
    status, note = compare.check(spark, con, name, load()[name], FOLDER)
    assert status in ("ok", "EMPTY"), note


def test_names_and_contract():
    import __spark_entry__ as entry
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 190
    assert entry.FLAGSHIP in queries


def test_entry_has_rows(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert {"camera_id", "band", "hours", "hits", "visits", "rate"} == set(df.columns)
    assert df.count() > 0
