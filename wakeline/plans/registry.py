"""Every registered query of the core, and its SQL twin."""

from __future__ import annotations

from . import action_queries, decision_queries, evidence_queries, graph_queries, index_queries, ledger_queries, rule_queries, text_queries

QUERIES = graph_queries.QUERIES | text_queries.QUERIES | rule_queries.QUERIES | decision_queries.QUERIES | index_queries.QUERIES | action_queries.QUERIES | ledger_queries.QUERIES | evidence_queries.QUERIES
ORACLE_SQL = graph_queries.ORACLE_SQL | text_queries.ORACLE_SQL | rule_queries.ORACLE_SQL | decision_queries.ORACLE_SQL | index_queries.ORACLE_SQL | action_queries.ORACLE_SQL | ledger_queries.ORACLE_SQL | evidence_queries.ORACLE_SQL
