"""All queries of the core by name."""

from __future__ import annotations

from . import data_problems, evidence_queries, job_queries, relational_queries, scalar_queries, source_queries, spatial_queries

FLAGSHIP = "q_classify_levels"
_MODULES = (data_problems,)
_REGISTRIES = (scalar_queries.query, relational_queries.query, spatial_queries.query, evidence_queries.query, source_queries.query, job_queries.query)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()} | {name: query for part in _REGISTRIES for name, query in part.queries.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()} | {name: sql for part in _REGISTRIES for name, sql in part.oracles.items()}
