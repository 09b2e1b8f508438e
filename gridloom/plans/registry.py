"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import kernel_queries, more_oracles, raster_queries, shape_queries, source_queries, stream_queries

_PARTS = (raster_queries, shape_queries, kernel_queries, source_queries, stream_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for p in _PARTS for k, q in p.ORACLES.items()}
ORACLES |= more_oracles.ORACLES
