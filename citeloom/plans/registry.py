"""All core queries and their SQL twins, by name."""

from __future__ import annotations

from citeloom.plans import citation_queries, ledger_queries, training_queries

_PARTS = [citation_queries, ledger_queries, training_queries]
QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
SQL = {k: s for m in _PARTS for k, s in m.SQL.items()}
FLAGSHIP = "ag03_eval_grouping_sets"
