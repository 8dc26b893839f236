"""All queries over the engine's own operators, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aeroframe.queries import registry
from aeroframe.queries import geometry, neighbours, reductions, scalars, spectra, texts  # noqa: F401  registration


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
