"""All queries of the retrieval engine, with SQL where SQL can express them."""

from spindrift.catalog import evidence, indexes, providers, relations, retrieval, temporal  # noqa: F401
from spindrift.catalog.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
