"""All queries of the core by name, and the SQL that checks them."""

from __future__ import annotations

from almanac.plans import change_queries, company_queries, history_queries, label_queries, problems, record_queries, rollup_queries, search_queries

MODULES = [problems, history_queries, rollup_queries, search_queries, label_queries, record_queries, company_queries, change_queries]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
