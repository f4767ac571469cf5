"""Jobs and registered queries."""

from corpuscope.plans import (  # noqa: F401
    corpus_queries,
    record_queries,
    response_queries,
    stream_queries,
    text_queries,
)
from corpuscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
