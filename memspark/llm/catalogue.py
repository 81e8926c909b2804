"""All queries of the subpackage, and their SQL."""

from memspark.llm import queries, queries_sql

QUERIES = {**queries.QUERIES}
SQL = {**queries_sql.SQL}
