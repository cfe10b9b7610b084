"""A session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Rows of an Arrow batch; Spark's own default.
ARROW_ROWS, ARROW_DEFAULT = 2000, "10000"


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of fewer rows where it has Spark's default: whole documents pass through Python workers, and a batch is held by both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == ARROW_DEFAULT:
        spark.conf.set(key, ARROW_ROWS)
    return spark


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution. Anything else (memory, shuffle partitions) is the cluster's, or given as conf with underscores for dots."""
    builder = SparkSession.builder.appName("attestra").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return tuned((builder.master(master) if master else builder).getOrCreate())
