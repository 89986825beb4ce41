"""Registry of named queries over the test tables, each with its SQL oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs one operator over whole
tables; ``ORACLE[name]`` is the DuckDB SQL computing the same result from the
same parquet views. Column names and types are aligned on both sides:
counts BIGINT, ranks INT, ratios DOUBLE rounded to 6 where floating-point
summation order could differ. The queries live in ``plans.queries``, one
module per family; importing them registers them here.
"""

from __future__ import annotations

from tessera.plans.queries import (  # noqa: F401  (importing registers the queries)
    agreement, extraction, ingest, lookups, ml, readout, retrieval, sources, stats, text, vectors)
from tessera.plans.registry import ORACLE, QUERIES, QueryFn, register  # noqa: F401

__all__ = ["ORACLE", "QUERIES", "QueryFn", "register"]
