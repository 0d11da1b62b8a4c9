"""The registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from talus.plans import company_queries, discovery_queries, matching_queries, posting_queries, profile_queries, resume_queries, search_queries, snapshot_queries, source_queries, star_queries, text_queries

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (text_queries, posting_queries, company_queries, discovery_queries, matching_queries, profile_queries, resume_queries, search_queries, snapshot_queries, source_queries, star_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
