"""All registered queries of the document-to-speech engine, with their SQL oracles."""

from . import book_queries, job_queries, text_queries

QUERIES = text_queries.QUERIES | book_queries.QUERIES | job_queries.QUERIES
ORACLE_SQL: dict[str, str] = text_queries.ORACLE_SQL | book_queries.ORACLE_SQL | job_queries.ORACLE_SQL
