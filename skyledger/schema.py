"""Catalogue tables as Spark schemas. Camera times have no zone, audit times are instants."""

from __future__ import annotations

TABLES = {
    "project": "id string, name string, description string, created_at timestamp, updated_at timestamp",
    "session": "id string, project_id string, name string, status string, date_start timestamp_ntz, date_end timestamp_ntz, created_at timestamp, updated_at timestamp",
    "image": "id string, session_id string, file_path string, captured_at timestamp_ntz, latitude double, longitude double, altitude_m double, width int, height int, format string, file_size bigint, content_hash string, raw_sibling_id string, analysis_ready boolean, blur_score double, is_blurry boolean",
    "plot": "id string, project_id string, session_id string, name string, rings array<array<array<double>>>, area_m2 double, perimeter_m double, source_aoi_id string, created_at timestamp",
    "plot_indicator": "plot_id string, plugin_id string, execution_id string, indicator string, value double, text_value string, unit string, created_at timestamp",
    "plugin_image_result": "id string, image_id string, session_id string, plugin_id string, execution_id string, metrics string, artifacts string, created_at timestamp",
    "temporal_comparison": "id string, project_id string, before_session_id string, after_session_id string, before_date date, after_date date, before_coverage double, after_coverage double, delta double, level string, created_at timestamp",
}
KEYS = {"plot_indicator": ["plot_id", "plugin_id", "indicator"], "plugin_image_result": ["image_id", "plugin_id"]}
