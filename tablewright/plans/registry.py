"""All registered queries and their SQL checks."""

from __future__ import annotations

from tablewright.plans import business_plans, entity_plans, quality_plans, service_plans, table_plans

PARTS = (quality_plans, table_plans, entity_plans, business_plans, service_plans)

QUERIES = {name: run for part in PARTS for name, run in part.QUERIES.items()}
CHECKS = {name: sql for part in PARTS for name, sql in part.CHECKS.items()}
