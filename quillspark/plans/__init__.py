"""Registered queries: one per operator ID of the survey, each bound to the
driver's test tables, plus the equivalent DuckDB SQL used as an oracle."""

from quillspark.plans.registry import QUERIES, ORACLE, all_queries, all_oracles

__all__ = ["QUERIES", "ORACLE", "all_queries", "all_oracles"]
