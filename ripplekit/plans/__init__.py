"""Registered query plans (Spark) and their DuckDB oracle SQL."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import q_core, q_filters, q_joins, q_aggs, q_windows, q_reshape, q_text, q_models, q_sources, q_extra, q_tuning, q_methods, q_classify, q_ranks, q_days, q_blocks  # noqa: F401,E402
