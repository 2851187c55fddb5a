"""The reference queries, as the entry point registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvellum.plans import boundary, boundary_sql, oracles
from corvellum.plans import queries as Q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (*Q.ALL, *boundary.ALL)}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | boundary_sql.SQL
