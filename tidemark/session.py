"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Windows and text forms of instants are UTC; repeated JSON keys keep the last value.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# For session builders (static): recording a Python call site per Column call makes building a
# large plan take seconds.
RECOMMENDED = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the run-time settings every entry point needs and return the session."""
    for key, value in _REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a local master takes a folder in the warehouse; on a cluster
    that folder may be the driver's own, so there it must be set.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    context.setCheckpointDir(folder)
    return folder
