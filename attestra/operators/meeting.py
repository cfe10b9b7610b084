"""Searches and the rows of the cells they look into, in chunks: no task has a whole cell."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.tables import materialize, small


def meeting(searches: DataFrame, rows: DataFrame, key: str, columns: list[str], f: Callable[[pa.Table, pa.Table], pa.Table], schema: str, chunk_rows: int, chunk_searches: int) -> DataFrame:
    """searches and rows: cell (long), key and columns, written before. f for every chunk of a cell's searches and every chunk of its rows.

    A cell's rows and searches are dealt to chunks of about that many by a hash of their key, and each side goes to all chunks of the other:
    in a cell of ordinary size one. The sizes of cells that have both are the only thing that is broadcast, if they are few.
    """
    chunks: Callable[[int], Column] = lambda n: F.ceil(F.col("count") / n).cast("int")
    sizes = rows.groupBy("cell").count().select("cell", chunks(chunk_rows).alias("row_chunks"))
    asked = searches.groupBy("cell").count().select("cell", chunks(chunk_searches).alias("search_chunks"))
    sizes = small(materialize(sizes.join(asked, "cell"), "cell-sizes"))
    own: Callable[[str], Column] = lambda n: F.pmod(F.xxhash64(key), F.col(n))
    every: Callable[[str], Column] = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    left = searches.join(sizes, "cell").withColumn("s", own("search_chunks")).withColumn("r", every("row_chunks"))
    right = rows.join(sizes, "cell").withColumn("r", own("row_chunks")).withColumn("s", every("search_chunks"))
    pick = ["cell", "s", "r", key, *columns]
    return left.select(*pick).groupBy("cell", "s", "r").cogroup(right.select(*pick).groupBy("cell", "s", "r")).applyInArrow(f, schema)
