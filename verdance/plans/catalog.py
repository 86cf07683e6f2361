"""All queries of the library but those of the optional corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluation, joins, plants, raster, selection, signal, trackers, tracking
from ..sources import files
from ..streaming import carry
from . import plant_queries, rule_queries, selection_queries, series_queries, table_queries

# Kernels travel with their closures, so executors need no installed copy of the library.
for _module in (evaluation, joins, plants, raster, selection, signal, trackers, tracking, files, carry, rule_queries):
    cloudpickle.register_pickle_by_value(_module)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**series_queries.QUERIES, **table_queries.QUERIES, **plant_queries.QUERIES, **selection_queries.QUERIES, **rule_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**series_queries.SQL, **table_queries.SQL, **plant_queries.SQL, **selection_queries.SQL, **rule_queries.SQL}
