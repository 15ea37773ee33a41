"""Imports every query module so that each registers its queries."""

from quarry.plans import (  # noqa: F401
    io_queries, model_queries, record_queries, term_queries, text_queries, trend_queries, vector_queries)
