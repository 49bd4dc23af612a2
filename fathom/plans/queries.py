"""All registered queries of the library itself."""

from . import design_queries, graph_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
