"""Registered queries over the provided tables, with SQL that says the same."""

from __future__ import annotations

from tidemark.plans import analysis_queries, audit_queries, extension_queries, frame_queries, more_queries, rule_queries, walk_queries, window_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    return QUERIES["res03_flagship_conditional_hit_rate"](spark, sf_dir)
