"""All registered queries of the core and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftmill.plans import data_quality, file_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (file_queries, data_quality)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.oracle_sql().items()}
