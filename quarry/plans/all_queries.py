"""Every query of the library, gathered from the modules that register them."""

from . import byte_queries, codec_queries, relational_queries, scalar_queries, session_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
