"""All registered queries and their SQL answers."""

from __future__ import annotations

from millrace.plans import data_queries, model_queries

_MODULES = (data_queries, model_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ANSWERS = {name: sql for m in _MODULES for name, sql in m.ANSWERS.items()}
