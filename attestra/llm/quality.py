"""Quality selection by importance resampling (Xie et al. 2023).

Two generative models over hashed word n-grams, one of target text and one of all text,
give each document the log of its importance weight: the sum over its n-grams of the log
ratio. Adding Gumbel noise and taking the top k samples documents without replacement in
proportion to their weights.

The raw model counts all documents. The target model counts a bounded sample of labelled
ones (TARGET_ROWS).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import as_bytes, by_volume, kth_largest, materialize, sliced
from attestra.llm.shingles import Words

LG_BUCKETS = 16
GRAMS = (1, 2)
#: Labelled documents that the target model is fitted on, at most (about; drawn by a hash of the id).
TARGET_ROWS = 50_000
#: Counts of the raw model, scaled to the target's size, that the target model has from the start: what it hasn't seen, it takes to be as in raw text.
SMOOTHING = 10.0


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the texts (ASCII in lower case), and the text it is of."""
    words = Words([t.lower() for t in texts])
    h = words.hashes()
    found = [words.runs(h, k) for k in GRAMS]
    text = np.searchsorted(words.first, np.concatenate([at for at, _ in found]), "right") - 1
    return (np.concatenate([x for _, x in found]) >> np.uint64(64 - LG_BUCKETS)).astype(np.int64), text


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's counts: bucket, raw, target. Columns: text, whether it is target text."""
    raw, target = np.zeros(1 << LG_BUCKETS, np.int64), np.zeros(1 << LG_BUCKETS, np.int64)
    for batch in sliced(batches):
        texts, wanted = as_bytes(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for part in by_volume(texts):
            bucket, text = grams(texts[part.start : part.stop])
            raw += np.bincount(bucket, minlength=len(raw))
            target += np.bincount(bucket[wanted[part.start : part.stop][text]], minlength=len(raw))
    (at,) = raw.nonzero()
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """docs: doc_id, text. The log ratio of each bucket; all zero without target text."""
    share = TARGET_ROWS / max(1, target_ids.count())
    some = target_ids.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) < int(min(1, share) * (1 << 30)))
    flagged = docs.join(F.broadcast(some.select("doc_id", F.lit(True).alias("wanted"))), "doc_id", "left")
    counts = flagged.where("text IS NOT NULL").select("text", F.coalesce("wanted", F.lit(False))).mapInArrow(counted, "bucket long, raw long, target long")
    table = materialize(counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), "buckets").toArrow()
    bucket, raw, target = (table.column(c).to_numpy() for c in ("bucket", "raw", "target"))
    out = np.zeros(1 << LG_BUCKETS)
    if target.any():
        out[bucket] = np.log((target + SMOOTHING) / (raw * (target.sum() / raw.sum()) + SMOOTHING))
    return out


def resampled(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 4) -> DataFrame:
    """One row per input row: doc_id, log_weight, perturbed (with Gumbel noise), kept.

    Target text: documents with quality 1 and not toxic 1. Null or empty texts have weight 0 in logs, all texts if there
    is no target text. The noise is a function of the id, so reruns agree; k is ``keep`` of all rows, rounded up (by
    default the part of the labelled documents that have quality 1; all, if there are no labels), and rows that tie with
    the last one (repeated rows) are kept with it. Other columns are not looked at; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if keep is None:
        keep = labels.agg(F.avg(F.when(F.col("quality") == 1, 1.0).when(F.col("quality").isNotNull(), 0.0))).first()[0]
        keep = 1.0 if keep is None else keep
    target = labels.where("quality = 1 AND coalesce(toxic, 0) <> 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, materialize(target, "target")))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            weights = np.zeros(len(texts))
            for part in by_volume(texts):
                bucket, text = grams(texts[part.start : part.stop])
                weights[part.start : part.stop] = np.bincount(text, weights=shared.value[bucket], minlength=len(part))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights)], ["doc_id", "log_weight"])

    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = materialize(docs.mapInArrow(weigh, "doc_id long, log_weight double").withColumn("perturbed", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    edge = kth_largest(rows, "perturbed", -int(-keep * rows.count() // 1))
    return rows.withColumn("kept", F.col("perturbed") >= F.lit(edge))
