"""Session settings the library relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Wall-clock arithmetic is done in UTC and moved to the local zone explicitly.
# The JVM never compiles methods above 8000 bytes; wide cleaning projections exceed that
# when fused into one, and run several times faster when Spark splits them instead.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators need to an existing session."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, below the shared folder the cluster names.

    ``spark.checkpoint.dir`` must point at storage every executor can reach; without it
    there is no folder to use, and that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set: it names the folder all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
