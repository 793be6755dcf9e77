"""Every registered query; importing this module fills the registry."""

from __future__ import annotations

from assayer.plans import dataset_queries, judge_queries, metric_queries, routing_queries, run_queries, stream_queries, telemetry_queries  # noqa: F401
from assayer.plans.registry import QUERIES

__all__ = ["QUERIES"]
