"""The queries by name, and their SQL."""

from . import corpus, search

QUERIES = {**corpus.QUERIES, **search.QUERIES}
ORACLE_SQL = {**corpus.ORACLE_SQL, **search.ORACLE_SQL}
