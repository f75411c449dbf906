"""All queries of the core, and the SQL that gives the same rows."""

from __future__ import annotations

from inkgrain.plans import audit_plans, io_plans, literal_plans, review_plans, sampling_plans, score_plans

PARTS = [score_plans, audit_plans, sampling_plans, review_plans, literal_plans, io_plans]


def queries():
    return {k: v for p in PARTS for k, v in p.QUERIES.items()}


def oracle_sql():
    return {k: v for p in PARTS for k, v in p.SQL.items()}
