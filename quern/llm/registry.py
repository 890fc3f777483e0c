"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quern.llm import queries

QUERIES = {**queries.QUERIES}
SQL = {**queries.SQL}
