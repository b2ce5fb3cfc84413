"""All registered queries over the stored tables and the SQL each is held against."""

from __future__ import annotations

from sedimenta.plans import of_code, of_findings, of_graphs, of_history, of_imports, of_project, of_quality, of_reports, of_telemetry
from sedimenta.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "of_code", "of_findings", "of_graphs", "of_history", "of_imports", "of_project", "of_quality", "of_reports", "of_telemetry"]
