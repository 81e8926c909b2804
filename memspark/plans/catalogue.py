"""All queries of the core, and their SQL."""

from memspark.plans import data_problems, data_problems_sql, maintenance, maintenance_sql, retrieval, retrieval_sql, streams

QUERIES = {**data_problems.QUERIES, **retrieval.QUERIES, **maintenance.QUERIES, **streams.QUERIES}
SQL = {**data_problems_sql.SQL, **retrieval_sql.SQL, **maintenance_sql.SQL, **streams.SQL}
