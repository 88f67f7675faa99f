"""Named queries over the driver's tables: QUERIES and the SQL that each must agree with, ORACLE_SQL."""

from graphloom.queries.registry import ORACLE_SQL, QUERIES
from graphloom.queries import embeddings, graphs, labels, matching, mining  # noqa: E402,F401,I001

__all__ = ["ORACLE_SQL", "QUERIES"]
