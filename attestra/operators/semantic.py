"""get_semantic_company_context, semantic_peer_context_review."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.bounds import MOST_KEYS, bounded_limit
from attestra.functions.evidence import AVAILABLE, SUMMARY_ONLY
from attestra.tables import materialize

#: Numbers of the targets that are held against all vectors at once, and scores that a task has of them at once. Numbers from which a vector's products may overflow.
TARGET_VALUES, SCORES, HUGE = 1 << 20, 1 << 21, 1e100


def company_context(*kinds: DataFrame) -> DataFrame:
    """kinds: one row for each (corp, fy) each. All of them side by side, and a state: available if every kind is there, else summary_only."""
    marked = [k.withColumn(f"has_{i}", F.lit(True)) for i, k in enumerate(kinds)]
    joined = reduce(lambda a, b: a.join(b, ["corp", "fy"], "full"), marked)
    marks = [f"has_{i}" for i in range(len(kinds))]
    whole = reduce(lambda a, b: a & b, (F.col(m).isNotNull() for m in marks))
    return joined.withColumn("state", F.when(whole, AVAILABLE).otherwise(SUMMARY_ONLY)).drop(*marks)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """batch: id, vector. (ids, vectors) of those with a vector without nulls, for each length."""
    vectors = batch.column(1)
    lengths = vectors.value_lengths()
    for n in lengths.unique().drop_null().to_pylist():
        own = batch.filter(pa.compute.fill_null(pa.compute.equal(lengths, n), False))
        values = own.column(1).flatten()
        if values.null_count:
            whole = ~values.is_null().to_numpy(zero_copy_only=False).reshape(own.num_rows, n).any(axis=1)
            own = own.filter(pa.array(whole))
            values = own.column(1).flatten()
        yield own.column(0).to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, n)


def first_of_each(owner: np.ndarray, score: np.ndarray, peer: np.ndarray, k: int) -> np.ndarray:
    """Which are among the k best of their owner: by score, NaN above all, then by peer. In the owners' order."""
    named = np.isnan(score)
    order = np.lexsort((np.unique(peer, return_inverse=True)[1], np.where(named, 0.0, -score), ~named, owner))
    begins = np.flatnonzero(np.diff(owner[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order))) < k]


class Nearest:
    """The k best of all vectors seen so far, for each target of a block (of one length, all numbers below HUGE).

    A product of matrices tells which pairs may be among them, with what rounding can do to it; the scores of these are summed one by one, as dot() does.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        self.least = np.full(len(ids), -np.inf)
        self.owner, self.score, self.peer = np.zeros(0, np.int64), np.zeros(0), ids[:0]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, SCORES // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            self._add(ids[at : at + step], vectors[at : at + step])

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        plain = (np.abs(vectors) < HUGE).all(axis=1)
        rounding = 4 * (vectors.shape[1] + 2) * np.finfo(float).eps * np.sqrt((vectors[plain] ** 2).sum(axis=1)).max(initial=0) * self.norms + np.finfo(float).tiny
        about = np.full((len(self.ids), len(ids)), np.inf)  # others are looked at whatever they are
        about[:, plain] = self.vectors @ vectors[plain].T
        about[self.ids[:, None] == ids[None, :]] = -np.inf
        least = self.least - rounding
        new = np.isneginf(least)
        if len(ids) > self.k and new.any():
            least[new] = np.partition(about[new], len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 2 * rounding[new]
        least = np.where(np.isposinf(least), np.finfo(float).max, least)
        who, whom = np.nonzero((about >= least[:, None]) & ~np.isneginf(about) | np.isposinf(about))
        if not len(who):
            return
        score = np.zeros(len(who))
        with np.errstate(all="ignore"):
            for i in range(vectors.shape[1]):
                score += self.vectors[who, i] * vectors[whom, i]
        owner, score, peer = np.concatenate([self.owner, who]), np.concatenate([self.score, score]), np.concatenate([self.peer, ids[whom]])
        kept = first_of_each(owner, score, peer, self.k)
        self.owner, self.score, self.peer = owner[kept], score[kept], peer[kept]
        ends = np.flatnonzero(np.diff(self.owner, append=len(self.ids)))
        full = np.diff(ends, prepend=-1) >= self.k
        self.least[self.owner[ends[full]]] = np.where(np.isnan(self.score[ends[full]]), np.inf, self.score[ends[full]])


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("target").orderBy(F.desc("score"), "peer")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("target", "peer", "rank", "score")


def peer_context(vectors: DataFrame, targets: DataFrame, k: int = 5) -> DataFrame:
    """vectors and targets: id, vector (unit length). The k nearest of each target by cosine: target, peer, rank, score.

    Targets are a stated query set, held against all vectors in blocks of about TARGET_VALUES numbers; a task keeps the k best of each. Vectors that have no cosine
    with a target (null, with nulls, of another length) are the last: only targets with fewer than k others, or with such numbers themselves, are paired with these.
    """
    k = bounded_limit(k)
    spark = vectors.sparkSession
    vectors, targets = (df.select("id", "vector").where("id IS NOT NULL") for df in (vectors, targets))
    plain = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < HUGE)), F.lit(False))
    size = targets.where(plain).agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("length")).first()
    blocks = max(1, -(-size.n * max(1, size["length"]) // TARGET_VALUES))
    kind = vectors.schema["id"].dataType.simpleString()
    found = []
    for block in range(blocks):
        wanted = targets.where(plain & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).toArrow()
        shared = spark.sparkContext.broadcast(list(matrices(wanted.combine_chunks().to_batches()[0])) if wanted.num_rows else [])

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of = {v.shape[1]: Nearest(ids, v, k) for ids, v in shared.value}
            types = pa.int64()
            for batch in batches:
                types = batch.schema.field(0).type
                for ids, rows in matrices(batch):
                    if rows.shape[1] in of:
                        of[rows.shape[1]].add(ids, rows)
            for x in of.values():
                for at in range(0, len(x.owner), 10_000):
                    part = slice(at, at + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x.ids[x.owner[part]], types), pa.array(x.peer[part], types), pa.array(x.score[part])], ["target", "peer", "score"])

        found.append(vectors.mapInArrow(nearest, f"target {kind}, peer {kind}, score double"))
    best = materialize(ranked(reduce(DataFrame.unionByName, found), k), "nearest")
    odd = targets.where(~plain).select(F.col("id").alias("target"))
    whole = best.where(F.col("rank") == k).select("target").join(odd, "target", "left_anti")
    scarce = materialize(targets.join(whole, F.col("id") == F.col("target"), "left_anti"), "scarce")
    blocks = -(-scarce.count() // MOST_KEYS)
    if not blocks:
        return best
    rest = [_paired(vectors, scarce.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    return reduce(DataFrame.unionByName, rest, best.join(whole, "target", "left_semi"))


def _paired(vectors: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    wanted = targets.select(F.col("id").alias("target"), F.col("vector").alias("wanted"))
    return ranked(vectors.join(F.broadcast(wanted), F.col("id") != F.col("target")).select("target", F.col("id").alias("peer"), dot(F.col("vector"), F.col("wanted")).alias("score")), k)
