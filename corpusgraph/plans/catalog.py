"""All query modules; importing this fills the registry."""

from . import file_queries, graph_queries, metric_queries, model_queries, table_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
