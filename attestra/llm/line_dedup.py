"""Line dedup by distinct-site spread.

For each line digest, HyperLogLog sketches of the sites it occurs on are built in every
task and merged by aggregation: one small sketch per line and task is shuffled, whatever
the number of copies. Lines whose estimate is near MIN_SITES get an exact distinct count.
Lines on MIN_SITES sites or more are boilerplate and go from all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import as_bytes, materialize, sliced

MIN_SITES = 10
#: Sketches of 2**LG_K buckets: their estimates have a relative standard error of 1.04 / sqrt(2**LG_K).
LG_K = 9
#: Standard errors from MIN_SITES within which an estimate isn't relied on.
NEAR = 5 * 1.04 / 2 ** (LG_K / 2)
#: Boilerplate digests (16 bytes each) up to which all tasks have them; more are joined to the lines.
BLOCK_LINES = 1 << 20
BLANK = " \t\r"


def digests(docs: DataFrame, site_col: str) -> DataFrame:
    """line (digest), site: for every line that isn't blank. A null site is a site."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"), F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("-")).alias("site"))
    return lines.select(F.btrim("line", F.lit(BLANK)).alias("line"), "site").where("line <> ''").select(F.unhex(F.md5("line")).alias("line"), "site")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source") -> DataFrame:
    """line: digests of the lines on at least min_sites distinct sites."""
    lines = digests(docs, site_col)
    sketched = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    spread = materialize(sketched.where(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select("line")
    exact = lines.join(near, "line", "left_semi").distinct().groupBy("line").count().where(F.col("count") >= min_sites)
    far = spread.where(F.col("sites") > min_sites * (1 + NEAR))
    return far.select("line").unionByName(exact.select("line"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, text (the lines left, unchanged).

    Lines end at line feeds; they are compared without blanks, tabs and carriage returns at their ends. Blank lines
    stay. A null text has no lines and stays null. Repeated rows count on one site once. Other columns are not
    looked at; an empty table gives an empty result.
    """
    lines = materialize(boilerplate(docs.select("text", F.col(site_col).alias("site")), min_sites, "site"), "boilerplate")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), "text")
    return without_listed(rows, lines) if lines.count() <= BLOCK_LINES else without_joined(rows, lines)


def left_over(batch: pa.RecordBatch, gone: list[Callable[[int, bytes], bool] | None]) -> pa.RecordBatch:
    """doc_id, n_lines, n_removed, text, without the lines that each text's test (place, line) names."""
    n, texts = batch.column("n_removed").to_pylist(), as_bytes(batch.column("text"))
    for i, (text, test) in enumerate(zip(texts, gone, strict=True)):
        if text is not None and test is not None:
            own = text.split(b"\n")
            left = [x for at, x in enumerate(own) if not test(at, x)]
            n[i] += len(own) - len(left)
            texts[i] = b"\n".join(left)
    return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_removed", "text"])


def without_listed(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """rows, without lines: those are so few that all tasks have them."""
    listed = frozenset(lines.toArrow().column(0).to_pylist())
    gone = rows.sparkSession.sparkContext.broadcast(listed)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = lambda _, x: hashlib.md5(x.strip(BLANK.encode())).digest() in gone.value
        for batch in sliced(batches):
            yield left_over(batch, [test] * batch.num_rows)

    return rows.mapInArrow(remove, rows.schema)


def without_joined(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """rows, without lines: however many there are, digests and places are joined to them, and each text gets one list of the places that go. Rows are written once, so that their numbers stay."""
    numbered = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "numbered")
    placed = numbered.select("rid", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("rid", "at", F.btrim("line", F.lit(BLANK)).alias("line")).where("line <> ''")
    found = placed.select("rid", "at", F.unhex(F.md5("line")).alias("line")).join(lines.hint("merge"), "line").groupBy("rid").agg(F.collect_list("at").alias("gone"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield left_over(batch, [None if x is None else (lambda at, _, own=frozenset(x): at in own) for x in batch.column("gone").to_pylist()])

    return numbered.join(found.hint("merge"), "rid", "left").drop("rid").mapInArrow(remove, rows.schema)
