"""Registered queries and their SQL twins."""

from . import case_queries, grading_queries, head_queries, io_queries, raster_queries, score_queries, shape_queries, split_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
