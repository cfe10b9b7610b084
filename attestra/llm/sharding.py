"""Sharding by sampled splitters.

Size-weighted samples of the sort key give quantile boundaries; records go to the
ranges between them; ranges that turn out overfull are sampled again and subdivided.
Exact range sizes then place every record on the line of cumulative bytes, which is
cut into shards of equal length.

The key is (hash of the text, id, row number), so equal texts lie side by side and stay in
one shard. A group of equal texts over half a range would bend the cuts, so such groups
(two for each range at most) are not on the line: largest first, each goes to the shard
with the most room, and the line is cut to fill what room they leave. A group is cut between
its rows only where no shard can hold it within TOLERANCE of its equal part.

DataFrame functions only. The driver sees the sampled keys (ranges x samples_per_range),
the large groups and one row for each range; neither grows beyond MOST_RANGES.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.common import materialize

SCHEMA = "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"
KEY = ("h", "id", "rid")
LOWEST = -(2**63)
#: How far over its equal part a shard may be for a group of equal texts to stay whole.
TOLERANCE = 0.05
#: Rows that a range should have at most, and ranges at most.
RANGE_ROWS, MOST_RANGES = 1 << 20, 20_480


def splitter_count(boundaries: list[tuple[int, int, int]], key: Column) -> Column:
    """How many of the sorted boundaries are at or below the key, by binary search in one literal array."""
    if not boundaries:
        return F.lit(0)
    array = F.from_json(F.lit(json.dumps([dict(zip(KEY, b, strict=True)) for b in boundaries])), "array<struct<h:bigint,id:bigint,rid:bigint>>")
    steps = [1 << i for i in reversed(range(len(boundaries).bit_length()))]

    def step(found: Column, width: Column) -> Column:
        at = found + width
        return F.when((at <= len(boundaries)) & (F.get(array, at - 1) <= key), at).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def sampled(base: DataFrame, bytes_each: float, seed: int) -> list[tuple[tuple[int, int, int], float]]:
    """Keys drawn with a probability of size / bytes_each, in order, each with the bytes it stands for."""
    chance = F.pmod(F.xxhash64(F.lit(seed), *KEY), F.lit(1 << 40)) / float(1 << 40)
    rows = base.where(chance < F.col("size") / F.lit(bytes_each)).select(*KEY, "size").collect()
    return sorted(((r.h, r.id, r.rid), max(r.size, bytes_each)) for r in rows)


def quantiles(samples: list[tuple[tuple[int, int, int], float]], bytes_each: float, large: set[int], last: int | None = None) -> list[tuple[int, int, int]]:
    """A boundary for every ``bytes_each`` bytes. The first one within a group of equal texts moves to the group's start, so only a large group has more; last: the group that has that one already."""
    out: list[tuple[int, int, int]] = []
    passed, due = 0.0, bytes_each
    for key, weight in samples:
        if passed >= due and (key[0] != last or key[0] in large):
            out.append((key[0], LOWEST, LOWEST) if key[0] != last else key)
            last, due = key[0], passed + bytes_each
        passed += weight
    return out


def ranges(base: DataFrame, bytes_each: float, samples_per_range: int, seed: int, large: set[int]) -> tuple[DataFrame, list[int]]:
    """base with its range of the key, and each range's bytes. A range over twice bytes_each is sampled again, twice as finely each time, and subdivided, until none is left that has two keys."""
    boundaries = quantiles(sampled(base, bytes_each / samples_per_range, seed), bytes_each, large)
    again = 0
    while True:
        ranged = base.withColumn("range", splitter_count(boundaries, F.struct(*KEY)))
        filled = {r["range"]: r for r in ranged.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("largest")).collect()}
        # one row that is a range by itself leaves nothing to divide
        overfull = [r["range"] for r in filled.values() if r["size"] > 2 * bytes_each + r["largest"] and r["n"] > 1]
        if not overfull:
            return ranged, [filled[part]["size"] if part in filled else 0 for part in range(len(boundaries) + 1)]
        again += 1
        drawn = sampled(ranged.where(F.col("range").isin(overfull)), bytes_each / samples_per_range / 2**again, seed + again)
        found = {b for part in overfull for b in quantiles([x for x in drawn if bisect_right(boundaries, x[0]) == part], bytes_each, large, boundaries[part - 1][0] if part else None)}
        boundaries = sorted({*boundaries, *found})


def packed(groups: list[tuple[int, int]], shards: int, part: float) -> tuple[list[tuple[int, float, float, int]], list[float]]:
    """groups: (hash, bytes). Places them, largest first: (hash, from, to, shard), in bytes of the group; and the bytes of each shard. A piece is a whole group wherever one shard has room for it."""
    load, pieces = [0.0] * shards, []
    for h, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        begin = 0.0
        while begin < size:
            shard = min(range(shards), key=lambda s: (load[s], s))
            rest = size - begin
            take = rest if load[shard] + rest <= part * (1 + TOLERANCE) else max(part - load[shard], part / 1000)
            take = min(take, rest)
            pieces.append((h, begin, begin + take, shard))
            load[shard] += take
            begin += take
    return pieces, load


def rows_of(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Few rows that the driver made, as a table."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shard_by_splitters(docs: DataFrame, shards: int = 40, ranges_per_shard: int = 32, samples_per_range: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null).

    size: UTF-8 bytes plus 16; a null text has none, and the checksum of an empty one. A null id sorts
    first. Repeated rows are rows of their own. Equal texts share a shard wherever one holds them within TOLERANCE
    of its part; shards then differ from that part by TOLERANCE and half a range on either side, or by the longest text. A text longer
    than a shard leaves neighbours short of rows, down to none. An empty table gives an empty result. Other columns
    are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "sizes",
    )
    total, rows = base.agg(F.sum("size"), F.count("*")).first()
    if not total:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    part = total / shards
    each = max(ranges_per_shard, min(MOST_RANGES // shards, -(-rows // (RANGE_ROWS * shards))))
    spark, bytes_each = docs.sparkSession, part / each
    large = {r.h: r.bytes for r in base.groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > bytes_each / 2).collect()}
    pieces, load = packed(list(large.items()), shards, part)
    ranged, filled = ranges(base.withColumn("large", F.col("h").isin(list(large))), bytes_each, samples_per_range, seed, set(large))

    # where each range begins on the line, and each range's stretch of a large group in the group
    bytes_in = ranged.groupBy("range", F.when(F.col("large"), F.col("h")).alias("h")).agg(F.sum("size").alias("bytes")).collect()
    on_line = {r["range"]: r.bytes for r in bytes_in if r.h is None}
    begins = list(accumulate((on_line.get(x, 0) for x in range(len(filled))), initial=0))
    of_group = {h: {"h": h, "ends": [p[2] for p in pieces if p[0] == h], "shards": [p[3] for p in pieces if p[0] == h]} for h in large}
    places, passed = [{"range": x, "group": None, "begin": n, "ends": None, "to": None} for x, n in enumerate(begins[:-1])], dict.fromkeys(large, 0)
    for r in sorted((r for r in bytes_in if r.h is not None), key=lambda r: r["range"]):
        places.append({"range": r["range"], "group": r.h, "begin": passed[r.h], "ends": of_group[r.h]["ends"], "to": of_group[r.h]["shards"]})
        passed[r.h] += r.bytes
    places = rows_of(spark, places, "range:int,`group`:bigint,begin:bigint,ends:array<double>,to:array<int>")
    room = [max(0.0, part - x) for x in load]
    cuts = [x * begins[-1] / (sum(room) or 1.0) for x in accumulate(room)][:-1]  # what stands over the equal part in one shard, all others give

    in_order, group = Window.partitionBy("range").orderBy(*KEY), Window.partitionBy("range", "h")
    so_far = Window.unboundedPreceding, 0
    ranged = ranged.withColumn("group", F.when(F.col("large"), F.col("h"))).join(F.broadcast(places.withColumnRenamed("range", "its_range").withColumnRenamed("group", "its_group")), F.col("range").eqNullSafe(F.col("its_range")) & F.col("group").eqNullSafe(F.col("its_group")))
    line_end = F.sum(F.when(F.col("large"), 0).otherwise(F.col("size"))).over(in_order.rowsBetween(*so_far))
    group_end = F.sum("size").over(group.orderBy("id", "rid").rowsBetween(*so_far))
    placed = ranged.withColumn("line_end", line_end).withColumn("group_end", group_end)
    placed = placed.withColumn("last", F.max("line_end").over(group)).withColumn("bytes", F.sum("size").over(group))
    middle = F.col("begin") + F.when(F.col("large"), F.col("group_end") - F.col("size") / 2).otherwise(F.col("last") - F.col("bytes") / 2)
    cut = reduce(lambda n, x: n + F.when(F.col("middle") >= x, 1).otherwise(0), cuts, F.lit(0))
    piece = F.get("to", F.least(F.size("to") - 1, F.size(F.filter("ends", lambda e: e <= F.col("middle")))))
    placed = placed.withColumn("middle", middle).withColumn("shard", F.when(F.col("large"), piece).otherwise(cut))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", *KEY, "range", "shard"), "placed")
    # a row for each range, and one more for each cut between shards and each large group
    before = placed.groupBy("shard", "range").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slot = F.row_number().over(Window.partitionBy("range", "shard").orderBy(*KEY)) - 1 + F.col("before")
    return placed.join(F.broadcast(before), ["shard", "range"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
