"""The canonical tables of a release, with their schemas."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.evidence import AVAILABLE
from attestra.operators.text_index import TextIndex
from attestra.sources.archive import read_release, write_release

#: corp and receipt are strings: leading zeros matter. fy: fiscal year.
SCHEMAS = {
    "company": "corp string, name string, code string",
    "filing": "receipt string, corp string, fy int, report_type string, filed_at timestamp_ntz",
    "fact": "corp string, fy int, reported_in int, account string, value decimal(38,2), receipt string",
    "section": "receipt string, corp string, fy int, kind string, topic string, text string, start int, `end` int, state string",
    "note": "receipt string, corp string, fy int, topic string, excerpt string, locator struct<section:string,start:int,`end`:int>, format map<string,string>, state string",
    "engagement": "corp string, fy int, auditor string, audit_fee decimal(38,2), non_audit_fee decimal(38,2), opinion string",
    "subsidiary": "parent string, child string, fy int",
    "kam": "corp string, fy int, topic string, receipt string",
    "disclosure": "event_id string, corp string, ts timestamp_ntz, type string, attrs string",
}

#: What tells sections apart.
SECTION_KEYS = ("corp", "fy", "receipt", "kind", "topic", "start")


@dataclass(frozen=True)
class Release:
    """Tables by name. One that isn't given is empty: nothing is known from it."""

    spark: SparkSession
    tables: Mapping[str, DataFrame]
    index_path: str | None = None

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Release:
        """A written release; its tables and its section index are read, never changed."""
        names = [r.table for r in spark.read.parquet(f"{path}/manifest").select("table").collect()]
        return cls(spark, {n: read_release(spark, path, n) for n in names}, f"{path}/section-index" if "section" in names else None)

    def write(self, path: str) -> DataFrame:
        """The tables, with an index of the sections; the manifest comes last and marks the release as complete."""
        if "section" in self.tables:
            TextIndex.build(self.indexed_sections, SECTION_KEYS, "text", f"{path}/section-index")
        return write_release(dict(self.tables), path)

    @property
    def indexed_sections(self) -> DataFrame:
        """Sections that may be shown, each with the keys that tell it apart."""
        return self["section"].where(F.col("state") == AVAILABLE).select(*SECTION_KEYS, "text")

    @cached_property
    def sections(self) -> TextIndex:
        """The index of the sections: the release's own, or one that is built in the shared folder when it is first asked for."""
        return TextIndex.at(self.spark, self.index_path) if self.index_path else TextIndex.build(self.indexed_sections, SECTION_KEYS, "text")

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], SCHEMAS[name])

    def features(self) -> DataFrame:
        """Per table that tells of companies and years, and year: companies that it tells of, and their share of the release's: what a release can answer, table by table."""
        n = F.lit(self["company"].select("corp").distinct().count())
        out = None
        for name in self.tables:
            df = self[name]
            if {"corp", "fy"} <= set(df.columns):
                rows = df.groupBy("fy").agg(F.countDistinct("corp").alias("n_sourced")).select(F.lit(name).alias("table"), "fy", n.alias("n_companies"), "n_sourced", F.try_divide("n_sourced", n).alias("ratio"))
                out = rows if out is None else out.unionByName(rows)
        return out

    def coverage(self) -> DataFrame:
        """Per year: companies in the release, those with a filing, and their share. Grades are this ratio and no more."""
        known = self["company"].select("corp").distinct()
        filed = self["filing"].join(known, "corp", "left_semi").groupBy("fy").agg(F.countDistinct("corp").alias("n_sourced"))
        n = F.lit(known.count())
        return filed.select("fy", n.alias("n_companies"), "n_sourced", (F.col("n_sourced") / n).alias("ratio"))
