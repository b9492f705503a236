"""Named queries of the engine's own operators and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import documents, kernels


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in kernels.KERNELS.items()} | documents.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in kernels.KERNELS.items()} | documents.SQL
