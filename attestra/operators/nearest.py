"""Nearest peers on several measures: exact, by a k-d partition.

A tree over a sample cuts the space into cells. A target first looks into its own cell; its k-th
distance there is a ball that holds all better peers, and it visits the cells whose boxes the ball touches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.bounds import bounded_limit
from attestra.operators.meeting import meeting
from attestra.tables import materialize, small

#: Rows that the tree is built from, about; rows of a cell, about; cells at most.
SAMPLE, CELL_ROWS, MOST_CELLS = 50_000, 2048, 4096
#: Rows, and targets, that meet in a task at once, about.
CHUNK_ROWS, CHUNK_TARGETS = 8192, 1024


def grown(points: np.ndarray, cells: int) -> tuple | int:
    """(dimension, cut, below, above), or 0: up to ``cells`` cells, each cut at the median of its widest dimension."""
    if cells < 2 or len(points) < 2:
        return 0
    spread = points.max(axis=0) - points.min(axis=0)
    at = int(spread.argmax())
    cut = float(np.median(points[:, at]))
    below = points[:, at] < cut
    if not below.any():
        return 0
    return at, cut, grown(points[below], cells // 2), grown(points[~below], cells - cells // 2)


def placed(points: np.ndarray, tree: tuple | int) -> np.ndarray:
    """Each point's cell: the path to it, as bits behind a one."""
    out = np.ones(len(points), np.int64)
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if node and len(at):
            above = points[at, node[0]] >= node[1]
            out[at] = out[at] * 2 + above
            todo += [(node[2], at[~above]), (node[3], at[above])]
    return out


def coordinates(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    if not table.num_rows:
        return np.zeros((0, 1))
    column = table.column("point")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def best(targets: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of a chunk for each target: target, peer, distance (squared; summed measure by measure). A row isn't its own peer; ties go to the lower key."""
    if not targets.num_rows or not rows.num_rows:
        targets, rows = targets.slice(0, 0), rows.slice(0, 0)
    theirs, points = rows.column("key").to_numpy(), coordinates(rows)
    order = np.argsort(theirs, kind="stable")
    theirs, points = theirs[order], points[order]
    out: list[tuple] = []
    for name, at in zip(targets.column("key").to_pylist(), coordinates(targets), strict=True):
        distance = np.zeros(len(points))
        for i in range(points.shape[1]):
            distance += (points[:, i] - at[i]) * (points[:, i] - at[i])
        distance[theirs == name] = np.inf
        few = min(k, len(distance))
        (near,) = np.nonzero(distance <= np.partition(distance, few - 1)[few - 1])
        near = near[np.argsort(distance[near], kind="stable")][:few]
        out += [(name, int(theirs[x]), float(distance[x])) for x in near.tolist() if np.isfinite(distance[x])]
    target, peer, distance = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([pa.array(target, pa.int64()), pa.array(peer, pa.int64()), pa.array(distance, pa.float64())], ["target", "peer", "distance"])


def nearest_peers(companies: DataFrame, targets: DataFrame, measures: dict[str, float], k: int = 5, group: Sequence[str] = ()) -> DataFrame:
    """companies: corp (long, unique), measures, and columns of a group; targets: corp. target, peer, rank, distance, rule: for each
    target the k companies (of its group) with the smallest sum of squared differences of measures, each divided by its scale first.

    measures: scale by name. Ties go to the lower key. A company without one of the measures (null, not finite) has no peers and is none, as it
    can't be compared; fewer than k others give fewer peers; a null group is a group. Exact whatever the sample that cells are cut by.
    """
    spark, k = companies.sparkSession, bounded_limit(k)
    values = [F.col(m).cast("double") / F.lit(float(s)) for m, s in measures.items()]
    known = reduce(lambda a, b: a & b, (v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) for v in values))
    points = materialize(companies.where(known).select(F.col("corp").cast("long").alias("key"), F.xxhash64(*group).alias("group") if group else F.lit(0).cast("long").alias("group"), F.array(*values).alias("point")), "points")
    n = points.count()
    share = min(1.0, SAMPLE / max(1, n))
    drawn = points if share == 1 else points.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = drawn.select("point").toArrow()
    shared = spark.sparkContext.broadcast(grown(coordinates(sample), min(MOST_CELLS, -(-n // CELL_ROWS))) if sample.num_rows else 0)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(placed(coordinates(batch), shared.value))], [*batch.schema.names, "leaf"])

    # a cell: a leaf of the tree and a group
    routed = points.mapInArrow(route, "key long, group long, point array<double>, leaf long").withColumn("cell", F.xxhash64("leaf", "group"))
    homes = materialize(routed, "homes")
    asked = materialize(homes.join(targets.select(F.col("corp").cast("long").alias("key")).distinct(), "key", "left_semi"), "asked")
    first = lambda searches: meeting(searches, homes, "key", ["point"], lambda a, b: best(a, b, k), "target long, peer long, distance double", CHUNK_ROWS, CHUNK_TARGETS)
    order = Window.partitionBy("target").orderBy("distance", "peer")
    top = lambda found: found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    at_home = materialize(top(first(asked)), "at-home")

    # cells whose box is no farther than the k-th peer found at home
    dims = range(len(values))
    boxes = homes.groupBy("group", "cell").agg(F.array(*(F.min(F.col("point")[i]) for i in dims)).alias("low"), F.array(*(F.max(F.col("point")[i]) for i in dims)).alias("high"))
    boxes = small(materialize(boxes, "boxes"))
    reach = at_home.where(F.col("rank") == k).select(F.col("target").alias("key"), F.col("distance").alias("reach"))
    away = asked.withColumnRenamed("cell", "home").join(reach, "key", "left").join(boxes, "group").where("cell <> home")
    beyond = [F.greatest(F.col("low")[i] - F.col("point")[i], F.col("point")[i] - F.col("high")[i], F.lit(0.0)) for i in dims]
    # a hair wider than the ball, as sums of squares are rounded
    near = reduce(lambda a, b: a + b, (x * x for x in beyond)) <= F.col("reach") * (1 + 1e-9)
    away = materialize(away.where(F.col("reach").isNull() | near).select("cell", "key", "point"), "away")
    found = top(at_home.select("target", "peer", "distance").unionByName(first(away)))
    rule = f"nearest {k} by {', '.join(measures)}" + (f" within {', '.join(group)}" if group else "")
    return found.select("target", "peer", "rank", "distance", F.lit(f"adaptive:{rule}").alias("rule"))
