"""Joins to the latest before a moment, and facts as they were known.

A key of ordinary size is one sort. A hot key is cut into stretches of time by its own quantiles: each is
sorted for itself, and what the stretches before it end with is carried in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.tables import materialize, small

#: Rows of a key, of both sides together, beyond which it is cut; a stretch has about half of them.
HOT_ROWS = 1_000_000
BEFORE = Window.unboundedPreceding, -1


def as_of(left: DataFrame, right: DataFrame, key: str | Sequence[str], left_time: str, right_time: str, right_id: str) -> DataFrame:
    """Each row of left with the latest row of right, of the same key, at or before its time: left's columns and latest_<right_id> (null: none).

    Of several at that moment, the largest id. right_id may be a struct. Rows of right without id, key or time are not looked up;
    rows of left without key or time find nothing, and are not sorted.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kind = right.schema[right_id].dataType
    whole: Column = F.col(left_time).isNotNull()
    there: Column = F.col(right_time).isNotNull() & F.col(right_id).isNotNull()
    for k in keys:
        whole, there = whole & F.col(k).isNotNull(), there & F.col(k).isNotNull()
    row = F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("row")
    own = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    named = [f"k{i}" for i in range(len(keys))]
    marked = left.where(whole).select(*own, F.col(left_time).alias("at"), row, F.lit(None).cast(kind).alias("latest"))
    other = right.where(there).select(*own, F.col(right_time).alias("at"), F.lit(None).cast(marked.schema["row"].dataType).alias("row"), F.col(right_id).alias("latest"))
    rows = marked.unionByName(other)

    sizes = marked.select(*named).unionByName(other.select(*named)).groupBy(*named).agg(F.count("*").alias("n"))
    hot = materialize(sizes.where(F.col("n") > HOT_ROWS), "hot")  # no more than a HOT_ROWS-th of the rows
    most = hot.agg(F.max("n")).first()[0]
    if most is None:
        found = placed(rows, named)
    else:
        stretches = min(4096, -(-2 * most // HOT_ROWS))
        edges = rows.join(small(hot.select(*named)), named, "left_semi").groupBy(*named).agg(F.percentile_approx("at", [i / stretches for i in range(1, stretches)], 10_000).alias("edges"))
        edges = materialize(edges, "edges")
        dealt = rows.join(small(edges), named, "left").withColumn("stretch", F.when(F.col("edges").isNull(), 0).otherwise(F.size(F.filter("edges", lambda e: e < F.col("at"))))).drop("edges")
        # the last of each stretch, and of all before it
        last = dealt.where("row IS NULL").join(small(hot.select(*named)), named, "left_semi").groupBy(*named, "stretch").agg(F.max(F.struct("at", "latest")).alias("last"))
        every = edges.select(*named, F.explode(F.sequence(F.lit(0), F.lit(stretches - 1))).alias("stretch")).join(last, [*named, "stretch"], "left")
        carried = F.last("last", ignorenulls=True).over(Window.partitionBy(*named).orderBy("stretch").rowsBetween(*BEFORE))
        carry = materialize(every.select(*named, "stretch", carried["latest"].alias("carried")), "carry")
        found = placed(dealt, [*named, "stretch"]).join(small(carry), [*named, "stretch"], "left").select("row", F.coalesce("latest", "carried").alias("latest"))
    name = f"latest_{right_id}"
    without = left.where(~F.coalesce(whole, F.lit(False))).withColumn(name, F.lit(None).cast(kind))
    return found.select("row.*", F.col("latest").alias(name)).unionByName(without)


def placed(rows: DataFrame, group: list[str]) -> DataFrame:
    """The rows of left with the last of what is looked up before them in the group; of one moment, what is looked up comes first, in order of its id."""
    w = Window.partitionBy(*group).orderBy("at", F.col("row").isNotNull(), "latest").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("latest", F.last("latest", ignorenulls=True).over(w)).where("row IS NOT NULL").select(*group, "row", "latest")


def versions(facts: DataFrame, keys: Sequence[str], value: str, known_at: str, source: str) -> DataFrame:
    """What was known of each fact, and when: keys, value, known_from, known_to (exclusive; null: still), source, version (from 1).

    facts: keys, value, the time it became known, and its source. Of one moment, the largest source counts. A report that
    repeats the value known before makes no new version; one that withdraws it (null) does. Facts without a time are not
    known at any. The window holds the reports of one fact.
    """
    dated = facts.where(F.col(known_at).isNotNull()).groupBy(*keys, F.col(known_at).alias("known_from")).agg(F.max_by(F.struct(F.col(value).alias("value"), F.col(source).alias("source")), F.struct(F.col(source).isNotNull(), F.col(source))).alias("x"))
    w = Window.partitionBy(*keys).orderBy("known_from")
    said = dated.select(*keys, "known_from", F.col("x.value").alias("value"), F.col("x.source").alias("source"), F.row_number().over(w).alias("nth"), F.lag("x.value").over(w).alias("prior"))
    new = said.where((F.col("nth") == 1) | ~F.col("value").eqNullSafe(F.col("prior")))
    return new.select(*keys, "value", "known_from", F.lead("known_from").over(w).alias("known_to"), "source", F.row_number().over(w).cast("long").alias("version"))


def known_at(requests: DataFrame, found: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """requests: keys, a time and what else; found: of versions(). Adds version, value, known_from, source as they were known then; all null: nothing was."""
    looked_up = found.select(*keys, "known_from", F.struct("version", "value", "known_from", "source").alias("known"))
    rows = as_of(requests, looked_up, keys, time, "known_from", "known")
    return rows.select(*requests.columns, *(F.col(f"latest_known.{c}").alias(c) for c in ("version", "value", "known_from", "source")))
