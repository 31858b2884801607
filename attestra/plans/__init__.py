"""Registered queries over the given tables."""

from attestra.plans import assembly_queries, audit_queries, calibration_queries, claims_queries, decision_queries, evaluation_queries, measure_queries, model_queries, report_queries, series_queries
from attestra.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "assembly_queries", "audit_queries", "calibration_queries", "claims_queries", "decision_queries", "evaluation_queries", "measure_queries", "model_queries", "report_queries", "series_queries"]
