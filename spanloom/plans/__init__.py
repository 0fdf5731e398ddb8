"""All registered queries."""

from importlib import import_module

from spanloom.plans.registry import ENTRIES

MODULES = ["span_queries", "graph_queries", "traverse_queries", "session_metric_queries", "metric_queries", "trajectory_queries", "group_queries", "view_queries", "live_queries", "store_queries", "detail_queries", "density_queries"]

for _m in MODULES:
    import_module(f"spanloom.plans.{_m}")

__all__ = ["ENTRIES"]
