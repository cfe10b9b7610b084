"""Written intermediate tables, checked broadcasts and joins that keep nulls."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few short columns may be broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the setting is unset, a temporary one in local mode only: on a cluster each machine would write to its own disk."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="attestra-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/attestra-{name}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> None:
    """What is written at the path goes when the application ends."""
    files, where = _folder(spark, path)
    files.deleteOnExit(where)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and lost executors lose nothing.

    The files go when the application ends, or by discard().
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing will read again."""
    for df in tables:
        files, where = _folder(df.sparkSession, df.written_at)
        files.delete(where, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``limit`` rows, else as it is (then Spark shuffles). df: written before, so counting is cheap."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, where a null equals a null. The keys are left's."""
    other = right.select(*(F.col(k).alias(f"{k}__") if k in keys else F.col(k) for k in right.columns))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}__"))
    return left.join(other, same, how).drop(*(f"{k}__" for k in keys))
