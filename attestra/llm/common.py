"""What several operators share: text batches, one row of each group, ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ulp

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.tables import discard, materialize, small

__all__ = ["discard", "materialize", "small"]

#: Words are runs of anything but ASCII white space, as Python's bytes.split() and this pattern both have it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 2**63 - 1
#: Bins of a search for a rank.
BINS = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs, in their columns, with one row of each group: that with the smallest doc_id, nulls last; of rows that repeat it, one.

    groups: doc_id, th (xxhash64 of text) and root for each row of docs, written before. Rows are told by id and text.
    Those that go, and those of which only one stays, are marked; all others pass.
    """
    id_and_text = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th")
    least = materialize(groups.groupBy("root").agg(F.min(id_and_text).alias("least")), "least")
    keys = groups.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n")).join(small(least), "root").withColumn("thin", id_and_text.eqNullSafe(F.col("least")))
    marked = materialize(keys.where("NOT thin OR n > 1").select(F.xxhash64("doc_id", "th").alias("key"), "th", "thin"), "marked")
    th = F.xxhash64(F.col("text"))
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.xxhash64(F.col("doc_id").cast("long"), th).alias("key"), th.alias("th")).join(small(marked), ["key", "th"], "left")
    out = rows.where("thin IS NULL").select("row")
    if not marked.where("thin").isEmpty():
        out = out.unionByName(rows.where("thin").dropDuplicates(["key", "th"]).select("row"))
    return out.select("row.*")


def quoted(column: str) -> str:
    """A column's name for F.col, whatever dots and marks are in it."""
    return "`" + column.replace("`", "``") + "`"


def rows_with_text(docs: DataFrame, good: Callable[[pa.Array], list[bool]]) -> DataFrame:
    """The rows of docs, in their columns, whose text is good; ``good`` judges many texts at once, in tasks."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # other names may have dots, which mapInArrow takes for fields
    at = docs.columns.index("text")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(good(batch.column(at)), pa.bool_()))

    return plain.mapInArrow(filtered, plain.schema).toDF(*docs.columns)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that Python holds few rows at once as objects of its own."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def by_volume(texts: list[bytes], most: int = 1 << 20) -> Iterator[range]:
    """Consecutive index ranges of about ``most`` bytes, so that work arrays stay small whatever a batch holds. A longer text is a range of its own."""
    begin, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield range(begin, i)
            begin, total = i, 0
        total += len(text)
    if begin < len(texts):
        yield range(begin, len(texts))


def kth_largest(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of a column of finite doubles, from counts in ever finer bins (BINS rows reach the driver each time); infinity for none."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None or k <= 0:
        return float("inf")
    above = 0
    while low < high:
        width = (high - low) / BINS
        # where bins would be finer than numbers are, values are counted themselves
        bin_of = F.floor((F.col(key) - low) / width).cast("double") if width > ulp(max(-low, high)) else F.col(key).cast("double")
        counts = rows.where(F.col(key).between(low, high)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for b in sorted(counts, key=lambda b: -b["bin"]):
            if above + b["n"] >= k:
                low, high = b["low"], b["high"]
                break
            above += b["n"]
    return low
