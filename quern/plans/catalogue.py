"""All query modules of the library; importing this registers them."""

from . import event_queries, relational_queries, search_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
