"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans import cases, checks, evaluate, evidence, graph, records, retrieval, routing, runs

FLAGSHIP = "q13_bm25"
QUERIES: dict = {**retrieval.QUERIES, **graph.QUERIES, **evaluate.QUERIES, **checks.QUERIES, **routing.QUERIES, **records.QUERIES, **cases.QUERIES, **evidence.QUERIES, **runs.QUERIES}
ORACLE: dict[str, str] = {**retrieval.ORACLE, **graph.ORACLE, **evaluate.ORACLE, **checks.ORACLE, **routing.ORACLE, **records.ORACLE, **cases.ORACLE, **evidence.ORACLE, **runs.ORACLE}
