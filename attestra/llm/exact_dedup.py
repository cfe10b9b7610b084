"""Exact dedup with a split for heavy hitters.

Misra-Gries summaries of every partition's digests, added up, name all digests that may
have a share of HEAVY_SHARE of the rows. Their true counts and winners are computed with
a map-side aggregate; those that do have that share (at most 1 / HEAVY_SHARE digests) are
broadcast and settle their rows where they are. All other digests are shuffled: counts and
winners are aggregated, map side first, and joined back, so no group is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import ascii_lower, materialize, quoted

#: A digest with this share of the rows is heavy. There are 1 / HEAVY_SHARE of these at most.
HEAVY_SHARE = 1 / 512
#: Counters of a partition's summary: what they miss of a digest is under n / (COUNTERS + 1).
COUNTERS = 2048


def summarized(counts: dict[bytes, int], most: int) -> dict[bytes, int]:
    """The Misra-Gries step for many counters at once: all lose what the first one too many has, and those left with nothing go."""
    if len(counts) <= most:
        return counts
    cut = sorted(counts.values(), reverse=True)[most]
    return {k: n - cut for k, n in counts.items() if n > cut}


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's counters. Those of under 1 / (2 * COUNTERS) of its rows stay behind: they change a sum by less than that share."""
    counts: dict[bytes, int] = {}
    n = 0
    for batch in batches:
        n += batch.num_rows
        for x in batch.column(0).value_counts().to_pylist():
            counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
        counts = summarized(counts, COUNTERS)
    kept = {k: c for k, c in counts.items() if c > n / (2 * COUNTERS)}
    yield pa.RecordBatch.from_pydict({"digest": pa.array(kept.keys(), pa.binary()), "least": pa.array(kept.values(), pa.int64())})


def digest_of(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes after lower-casing A-Z; a null text counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after lower-casing A-Z only (by SHA-256); null counts as empty.
    The largest doc_id of a group stays; a null one stays only in a group of nulls (keep_id is null then).
    Rows that repeat that id all count as kept. Other columns are not looked at; an empty table gives an
    empty result.
    """
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest")), "digests")
    n = rows.count()
    named = rows.select("digest").mapInArrow(summaries, "digest binary, least bigint").groupBy("digest").agg(F.sum("least").alias("least"))
    least = n * (HEAVY_SHARE - 1 / (COUNTERS + 1) - 1 / (2 * COUNTERS))
    named = named.where(F.col("least") >= least)  # at most n / least of them
    group = (F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = rows.join(F.broadcast(named.select("digest")), "digest", "left_semi").groupBy("digest").agg(*group).where(F.col("group_size") >= n * HEAVY_SHARE)
    winners = materialize(winners, "winners")

    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # written, so that Spark can split the rows of a digest that is all but heavy in the join
    light = light.join(materialize(light.groupBy("digest").agg(*group), "light-groups"), "digest")
    heavy = rows.join(F.broadcast(winners), "digest").select(*light.columns)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return heavy.unionByName(light).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """docs, in their columns, with one row of each group of equal texts: that with the largest doc_id; nulls before all others; of rows that repeat it, one."""
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")
    rows = docs.select(row, digest_of(F.col("text")).alias("digest"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"))
    return rows.groupBy("digest").agg(F.max_by("row", "id").alias("row")).select("row.*")
