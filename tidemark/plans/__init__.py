"""Queries over the driver's tables: QUERIES and, where SQL can express them, ORACLE."""

from . import artifact_queries, calendar_queries, data_queries, filing_queries, gate_queries, model_queries, packet_queries, panel_queries, ridge_queries, source_queries, study_queries  # noqa: F401
from .tables import ORACLE, QUERIES  # noqa: F401
