"""All queries but those of the training-data subpackage, and their SQL."""

from __future__ import annotations

from . import documents, evaluation, graph, planning

QUERIES = documents.QUERIES | evaluation.QUERIES | graph.QUERIES | planning.QUERIES
SQL = documents.SQL | evaluation.SQL | graph.SQL | planning.SQL
