"""Registered queries: the operators applied to the driver's tables, with their DuckDB SQL."""

from motionspark.plans import axisguess, catalog, joins, lens, pose, recurrences, rows, splines, sync, trim, warp, windows
from motionspark.plans.registry import QUERIES, SQL

FLAGSHIP = "j03_bracket_slerp"

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "axisguess", "catalog", "joins", "lens", "pose", "recurrences", "rows", "splines", "sync", "trim", "warp", "windows"]
