"""Registry of the engine's queries on the driver tables, with the SQL each is compared with."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in ("stream_queries", "point_queries", "report_queries", "state_queries", "source_queries", "scene_queries", "lookup_queries", "model_queries", "gauge_queries", "image_queries", "profile_queries", "generator_queries", "input_queries", "operation_queries", "live_queries", "recording_queries", "motion_queries"):
    _module = import_module(f".{_name}", __package__)
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
