"""Report archives (ZIP with XML) as rows, and the canonical release tables.

Archives come in through Spark's binaryFile source and are unpacked in tasks. Broken ones
and members that can't be decoded become rows with an error, not failures.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.evidence import AVAILABLE, UNVERIFIED

SECTIONS = "archive string, member string, section int, title string, text string, start int, end int, error string"
#: Encodings tried for a member that isn't UTF-8.
ENCODINGS = ("utf-8-sig", "cp949")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """archive (path), content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select(F.col("path").alias("archive"), "content")


def members(content: bytes) -> Iterator[tuple[str, str | None, str | None]]:
    """(name, text, error) of the XML files in an archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(n for n in z.namelist() if n.lower().endswith(".xml")):
                raw = z.read(name)
                for encoding in ENCODINGS:
                    try:
                        yield name, raw.decode(encoding), None
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    yield name, None, "undecodable"
    except zipfile.BadZipFile:
        yield "", None, "corrupt archive"


def parsed(text: str) -> list[tuple[str | None, str, int, int]]:
    """(title, text, start, end) of the sections; start and end count characters over the texts of all sections."""
    declaration = text.find("?>") + 2 if text.startswith("<?xml") else 0
    out, at = [], 0
    for section in ElementTree.fromstring(text[declaration:]).iter("SECTION"):
        body = "\n".join("".join(p.itertext()).strip() for p in section.findall("P"))
        title = section.findtext("TITLE")
        out.append((title.strip() if title is not None else None, body, at, at + len(body)))
        at += len(body) + 1
    return out


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SECTIONS.split(", ")]
    types = [pa.int32() if x.split()[1] == "int" else pa.string() for x in SECTIONS.split(", ")]
    for batch in batches:
        rows = []
        for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for member, text, error in members(content or b""):
                try:
                    found = parsed(text) if text is not None else []
                except ElementTree.ParseError:
                    found, error = [], "malformed XML"
                rows += [(archive, member, i, *x, None) for i, x in enumerate(found)]
                if error or not found:
                    rows.append((archive, member, None, None, None, None, None, error or "no section"))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def report_sections(archives: DataFrame) -> DataFrame:
    """archive, member, section (number), title, text, start, end, error, state. What couldn't be read is ``unverified``: its place is known, its content isn't."""
    return archives.mapInArrow(unpacked, SECTIONS).withColumn("state", F.when(F.col("error").isNull(), F.lit(AVAILABLE)).otherwise(F.lit(UNVERIFIED)))


def write_release(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes tables as parquet, once: an existing release fails. Then their manifest (table, n_rows, columns), which marks the release as complete."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    rows = [(name, spark.read.parquet(f"{path}/{name}").count(), ",".join(df.columns)) for name, df in tables.items()]
    manifest = spark.createDataFrame(rows, "table string, n_rows long, columns string")
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return manifest


def read_release(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a complete release. Reads only."""
    if not spark.read.parquet(f"{path}/manifest").where(F.col("table") == table).count():
        raise ValueError(f"the release has no table {table}")
    return spark.read.parquet(f"{path}/{table}")
