"""All queries over the driver's tables, with the SQL that gives the same rows."""

from . import array_queries, detail_queries, document_queries, encoding_queries, frame_queries, layout_queries, replay_queries, stream_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
