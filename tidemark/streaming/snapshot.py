"""The declarations a run works with.

A running query has its declarations compiled in, so a run reads the registry when it starts
and restarts pick up changes. The last good set is kept for when the registry is unusable.
"""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tidemark import schemas
from tidemark.definitions import FeatureDefinition
from tidemark.sources.registry import load_active, registry_table

_LOG = logging.getLogger(__name__)


def load_definitions(
    spark: SparkSession, registry_path: str, snapshot_path: str
) -> list[FeatureDefinition]:
    """Active declarations of the registry table, else of the saved snapshot, else an error."""
    try:
        found = load_active(spark.read.schema(schemas.REGISTRY).parquet(registry_path))
    except (PySparkException, ValueError) as error:
        # Unreadable, or with a row that is no declaration.
        try:
            saved = load_active(spark.read.schema(schemas.REGISTRY).parquet(snapshot_path))
        except (PySparkException, ValueError):
            raise error from None
        _LOG.warning("registry unusable, using the last snapshot: %s", error)
        return saved
    registry_table(spark, found).coalesce(1).write.mode("overwrite").parquet(snapshot_path)
    return found
