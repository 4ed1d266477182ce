"""All core queries and their SQL, by name."""

from ledgerquarry.plans import dataset_queries, document_queries, paperwork_queries

QUERIES = {**paperwork_queries.QUERIES, **document_queries.QUERIES, **dataset_queries.QUERIES}
SQL = {**paperwork_queries.SQL, **document_queries.SQL, **dataset_queries.SQL}
