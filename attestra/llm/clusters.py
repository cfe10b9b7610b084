"""Centroid clustering by ball k-means.

A cluster is a ball: its centroid and the distance of its farthest member. Another centroid can
win members only if it is nearer to the centroid than twice the radius; these are the ball's
neighbours, in order of distance. A member nearer to its centroid than half the way to the first
neighbour is in the stable core and stays without a comparison. The others lie in annuli: beyond
half the way to the first l neighbours, where those l are compared and no others. All bounds are
integers, so ties are seen as ties.

Vectors stay where they are: a round writes each with its cluster, sums are combined in the
tasks, and k sums of as many numbers as a vector has reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import discard, materialize

#: Steps of a component: x becomes floor(SCALE * x).
SCALE = 256
#: Centroids at most: the driver compares all with all, and every task holds them.
MOST_CLUSTERS = 4096
#: Vectors that a task takes at once.
ROWS_AT_ONCE = 16_384
WHOLE = pa.decimal128(38, 0)


class Ball(NamedTuple):
    """A centroid, and the numbers of its neighbours with their squared distances from it, in ascending order."""

    centroid: list[int]
    neighbours: np.ndarray
    gaps: np.ndarray


def exact(bound: int, dims: int) -> type:
    """The type in which squared distances of components up to bound are exact: doubles, which hold whole numbers up to 2**53, else Python's integers."""
    return np.float64 if 4 * bound * bound * dims < 2**53 else object


def whole(x: np.ndarray, kind: type) -> np.ndarray:
    """Doubles that are whole numbers, as kind."""
    return x if kind is np.float64 else np.array([[int(y) for y in row] for row in x.tolist()], object).reshape(x.shape)


def balls(centroids: list[list[int]], reach: list[int] | None) -> list[Ball]:
    """reach: at least the radius of each ball; None: not known yet."""
    kind = exact(max((abs(x) for c in centroids for x in c), default=0), len(centroids[0]))
    points, out = np.array(centroids, kind), []
    for i in range(len(centroids)):
        gaps = ((points - points[i]) ** 2).sum(axis=1)
        order = np.array(sorted((j for j in range(len(centroids)) if j != i), key=lambda j: (gaps[j], j)), np.int64)
        near = gaps[order]
        if reach is not None:
            order = order[: np.searchsorted(near, 4 * reach[i] ** 2, "right")]
        out.append(Ball(centroids[i], order, gaps[order]))
    return out


def nearest(vectors: np.ndarray, own: np.ndarray, found: list[Ball]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (the smaller number of equal ones) and its squared distance, for vectors (whole numbers) that belong to the balls own."""
    bound = int(max(np.abs(vectors).max(initial=0), max(abs(x) for b in found for x in b.centroid)))
    kind = exact(bound, vectors.shape[1])
    vectors, centres = whole(vectors, kind), np.array([b.centroid for b in found], kind)
    best, distance = own.copy(), np.zeros(len(own), kind)
    for c in np.unique(own).tolist():
        (members,) = np.nonzero(own == c)
        d = ((vectors[members] - centres[c]) ** 2).sum(axis=1)
        # a tie at just half the way counts: the neighbour's number may be smaller
        annulus = np.searchsorted(found[c].gaps, 4 * d, "right")
        at, least = np.full(len(members), c), d.copy()
        for i, other in enumerate(found[c].neighbours[: annulus.max(initial=0)].tolist()):
            (some,) = np.nonzero(annulus > i)
            d = ((vectors[members[some]] - centres[other]) ** 2).sum(axis=1)
            nearer = (d < least[some]) | ((d == least[some]) & (other < at[some]))
            at[some[nearer]], least[some[nearer]] = other, d[nearer]
        best[members], distance[members] = at, least
    return best, distance


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of about ROWS_AT_ONCE rows."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks()


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)


def quantized(vectors: DataFrame, dims: int) -> DataFrame:
    """vectors: vec_id, v (any array of numbers). Those with dims components, all finite, as whole numbers in doubles; a member of no ball yet."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False))
            with np.errstate(over="ignore"):
                x = np.floor(SCALE * matrix(batch.column(1), dims))
            keep = np.isfinite(x).all(axis=1)
            x = x[keep] + 0.0  # no negative zeros
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, dims, np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), lists, pa.array(np.zeros(len(x), np.int32))], ["vec_id", "v", "cluster"])

    return vectors.mapInArrow(scaled, "vec_id long, v array<double>, cluster int")


def assigned(rows: DataFrame, found: list[Ball], dims: int) -> DataFrame:
    """rows: vec_id, v, cluster. vec_id, v, cluster and distance under these balls."""
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            cluster, distance = nearest(matrix(table.column("v"), dims), table.column("cluster").to_numpy(), shared.value)
            if distance.dtype == object:
                lengths = pa.array([Decimal(int(d)) if d < 10**38 else None for d in distance.tolist()], WHOLE)
            else:
                lengths = pa.array(distance.astype(np.int64)).cast(pa.decimal128(19, 0)).cast(WHOLE)
            yield from pa.table([table.column("vec_id"), table.column("v"), pa.array(cluster.astype(np.int32)), lengths], ["vec_id", "v", "cluster", "distance"]).to_batches()

    return rows.mapInArrow(place, "vec_id long, v array<double>, cluster int, distance decimal(38,0)")


def member_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's members by cluster: cluster, n, far (the largest squared distance), sums of each component. Columns: v, cluster, distance."""
    n: dict[int, int] = {}
    far: dict[int, Decimal] = {}
    sums: dict[int, np.ndarray] = {}
    for table in gathered(batches):
        cluster, distance = table.column("cluster").to_numpy(), table.column("distance")
        x = matrix(table.column("v"), len(table.column("v")[0]))
        x = whole(x, np.float64 if np.abs(x).max(initial=0) * len(x) < 2**53 else object)
        for c in np.unique(cluster).tolist():
            mine = cluster == c
            n[c] = n.get(c, 0) + int(mine.sum())
            sums[c] = sums.get(c, 0) + np.array([int(y) for y in x[mine].sum(axis=0).tolist()], object)
            theirs = distance.filter(pa.array(mine))
            far[c] = max(far.get(c, Decimal(0)), Decimal(10**38 - 1) if theirs.null_count else pc.max(theirs).as_py())
    columns = [pa.array(list(n), pa.int32()), pa.array(n.values(), pa.int64()), pa.array(far.values(), WHOLE), pa.array([[Decimal(y) for y in sums[c].tolist()] for c in n], pa.list_(WHOLE))]
    yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "far", "sums"])


def moved(rows: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """The floor of each ball's mean (an empty ball stays), and a bound on its radius from there: the old radius and the way it moved, rounded up."""
    parts = rows.select("v", "cluster", "distance").mapInArrow(member_sums, "cluster int, n long, far decimal(38,0), sums array<decimal(38,0)>")
    parts = parts.select("cluster", "n", "far", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("far").alias("far"))
    new, far = [list(c) for c in centroids], [0] * len(centroids)
    for r in parts.collect():  # k times dims rows
        new[r.cluster][r["at"]], far[r.cluster] = int(r.s) // r.n, int(r.far)
    ways = [sum((a - b) ** 2 for a, b in zip(c, d, strict=True)) for c, d in zip(centroids, new, strict=True)]
    return new, [isqrt(f) + 1 + isqrt(w) + 1 for f, w in zip(far, ways, strict=True)]


def ball_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", salt: str = "2:") -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance (squared) of each vector with dims components, all finite, in steps of 1 / SCALE; and the centroids.

    The first centroids are the vectors with the smallest sha256 of salt and id; of equal ids, the one that comes first by
    components; null ids come last. Fewer vectors than k: as many centroids. Then ``rounds`` times: each vector goes to the
    nearest centroid (ties: the smaller number), each centroid with members to the floor of their mean. A round in which no
    centroid moves is the last, as further ones would change nothing. Vectors of another length, with a null or a component
    that isn't finite (or isn't once it is scaled) are left out; repeated rows count each; other columns are not looked at;
    no vectors give an empty result. A distance that a long can't hold is null.
    """
    if not 1 <= k <= MOST_CLUSTERS:
        raise ValueError(f"k must be from 1 to {MOST_CLUSTERS}")
    rows = materialize(quantized(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")), dims), "vectors")
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select("v", digest.alias("digest")).orderBy(F.col("digest").isNull(), "digest", "v").limit(k).collect()
    centroids, reach = [[int(x) for x in r.v] for r in first], None
    if not centroids:
        return rows.select("vec_id", "cluster", F.lit(None).cast("long").alias("distance")), []
    for left in range(rounds, -1, -1):
        placed, used = materialize(assigned(rows, balls(centroids, reach), dims), "assigned"), rows
        discard(used)
        rows = placed
        if not left:
            break
        new, reach = moved(rows, centroids)
        if new == centroids:
            break
        centroids = new
    return rows.select("vec_id", "cluster", F.col("distance").try_cast("long").alias("distance")), centroids


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64) -> DataFrame:
    """One row for each vector that ball_clusters keeps: vec_id, cluster, distance, cluster_inertia and inertia (distances summed over the cluster and over all; null where a long can't hold them), centroid_sha256 (of the final centroid's components, joined by commas)."""
    rows, centroids = ball_clusters(vectors, k, rounds, dims)
    spark = vectors.sparkSession
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()}  # k rows
    fits = lambda x: int(x) if x is not None and x < 2**63 else None
    total = fits(sum(sums.values())) if None not in sums.values() else None
    about = [(c, fits(s), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    return rows.join(F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
