"""Ranks and medians in groups of any size.

A window over a group sorts it in one task. Here each group is cut into buckets by its own
approximate quantiles; rows are ordered within buckets, and bucket totals give what lies
before. Results are exact: the quantiles only decide how rows are dealt. Nulls make a group, and
a value, like any other. What is read more than once is written first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.tables import joined, materialize

BUCKETS = 64
EARLIER = Window.unboundedPreceding, -1


def dealt(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """df: written before. Adds bucket, by the group's quantiles of value (a number; null comes first)."""
    at = [i / BUCKETS for i in range(1, BUCKETS)]
    edges = df.groupBy(*group).agg(F.percentile_approx(F.col(value).cast("double"), at, 10_000).alias("edges"))
    bucket = F.when(F.col(value).isNull(), 0).otherwise(F.size(F.filter("edges", lambda e: e < F.col(value).cast("double"))))
    return joined(df, edges, group).withColumn("bucket", bucket).drop("edges")


def cumulated(rows: DataFrame, group: Sequence[str], value: str, order: Sequence[str], weight: str) -> DataFrame:
    """rows: with bucket. Adds before: the sum of weight (long) over the rows of the group that come earlier by order, which starts with value; total; and unknown, the weight of nulls."""
    within = Window.partitionBy(*group, "bucket").orderBy(*order).rowsBetween(*EARLIER)
    placed = materialize(rows.withColumn("within", F.coalesce(F.sum(weight).over(within), F.lit(0))), "ranked")
    sums = placed.groupBy(*group, "bucket").agg(F.sum(weight).alias("in_bucket"), F.sum(F.when(F.col(value).isNull(), F.col(weight)).otherwise(0)).alias("nulls"))
    in_group = Window.partitionBy(*group)
    earlier = F.coalesce(F.sum("in_bucket").over(in_group.orderBy("bucket").rowsBetween(*EARLIER)), F.lit(0))
    sums = sums.select(*group, "bucket", earlier.alias("bucket_start"), F.sum("in_bucket").over(in_group).alias("total"), F.sum("nulls").over(in_group).alias("unknown"))
    return joined(placed, sums, [*group, "bucket"]).withColumn("before", F.col("bucket_start") + F.col("within")).drop("bucket", "bucket_start", "within")


def value_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Adds pct (as percent_rank has it) and median. Equal values are counted before they are ordered; a null value comes first and counts in no median."""
    df = materialize(df, "values")
    counts = dealt(df.select(*group, value), group, value).groupBy(*group, "bucket", value).agg(F.count("*").alias("n"))
    ranked = cumulated(counts, group, value, [value], "n")
    known = F.col("total") - F.col("unknown")
    middle = [F.when((F.col("before") <= F.floor(m)) & (F.floor(m) < F.col("before") + F.col("n")), F.col(value)) for m in (F.col("unknown") + (known - 1) / 2, F.col("unknown") + known / 2)]
    medians = ranked.groupBy(*group).agg((F.max(middle[0]) * 0.5 + F.max(middle[1]) * 0.5).alias("median"))
    places = ranked.select(*group, value, F.coalesce(F.try_divide("before", F.col("total") - 1), F.lit(0.0)).alias("pct"))
    return joined(joined(df, places, [*group, value]), medians, group)


def with_neighbours(df: DataFrame, group: Sequence[str], value: str, key: str, k: int, block: int = 10_000) -> DataFrame:
    """Adds near: up to k rows before and k after in the group's order by value and key, as structs of key and value. Blocks of the order overlap by k rows."""
    rows = dealt(materialize(df, "ordered"), group, value).withColumn("one", F.lit(1).cast("long"))
    placed = cumulated(rows, group, value, [value, key], "one").drop("one", "total", "unknown")
    own, place = F.floor(F.col("before") / block), F.col("before") % block
    blocks = F.array_compact(F.array(own, F.when(place < k, own - 1), F.when(place >= block - k, own + 1)))
    spread = placed.withColumn("own", own).withColumn("block", F.explode(blocks))
    w = Window.partitionBy(*group, "block").orderBy("before")
    near = [F.collect_list(F.struct(F.col(key).alias("peer"), F.col(value).alias("peer_value"))).over(w.rowsBetween(*frame)) for frame in ((-k, -1), (1, k))]
    return spread.withColumn("near", F.concat(*near)).where("block = own").drop("own", "block", "before")
