"""All named queries of the library and their oracle SQL."""

from . import raster_queries, source_queries, table_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
