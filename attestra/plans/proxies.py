"""The driver tables as disclosure entities: an analogy, for queries on data of any size.

company: customer; its industry: market segment; its industry code: region digit and nation
number. Filing: order; receipt: order key; its state: order status. Auditor network: the
region of a line's supplier; fee: net line value, for audit where the return flag is N.
KAM topic: part type. Disclosure event: event. Report section: line of a document.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions.evidence import AVAILABLE, SUMMARY_ONLY, UNAVAILABLE, UNVERIFIED


class Span(NamedTuple):
    """Fiscal years of the filings: the first, the last, and the last that has filings up to its end (only up to that one are years compared)."""

    first: int
    last: int
    whole: int

    @property
    def years(self) -> range:
        return range(self.first, self.last + 1)


def span(spark: SparkSession, sf_dir: str) -> Span:
    """From the orders' dates, in one aggregate. A year is whole if there are orders in December, or after. Without orders, no years."""
    dates = read(spark, sf_dir, "orders").agg(F.year(F.min("o_orderdate")).alias("first"), F.year(F.max("o_orderdate")).alias("last"), (F.year(F.add_months(F.max("o_orderdate"), 1)) - 1).alias("whole")).first()
    return Span(dates.first, dates.last, dates.whole) if dates["first"] is not None else Span(1, 0, 0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def money(name: str) -> Column:
    """Exact sums, whatever the order of summation."""
    return F.col(name).cast("decimal(15,2)")


def rate(name: str) -> Column:
    return F.col(name).cast("decimal(5,2)")


def double(column: Column) -> Column:
    return column.cast("double")


def net() -> Column:
    return money("l_extendedprice") * (1 - rate("l_discount"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corp, name, industry, code, balance, nation."""
    nation = read(spark, sf_dir, "nation")
    code = F.concat(F.col("n_regionkey").cast("string"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    joined = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("c_custkey").alias("corp"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"), code.alias("code"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("long").alias("nation"))


def filings(spark: SparkSession, sf_dir: str, years: range | None = None) -> DataFrame:
    """receipt, corp, fy, filed_at, value (decimal), state, of all orders, or of those in the years asked for: half-open bounds, so that they reach the scan."""
    state = F.when(F.col("o_orderstatus") == "F", AVAILABLE).when(F.col("o_orderstatus") == "P", SUMMARY_ONLY).when(F.col("o_orderstatus") == "O", UNVERIFIED).otherwise(UNAVAILABLE)
    orders = read(spark, sf_dir, "orders")
    if years is not None:
        orders = orders.where(f"o_orderdate >= timestamp_ntz '{years[0]}-01-01' AND o_orderdate < timestamp_ntz '{years[-1] + 1}-01-01'")
    return orders.select(F.col("o_orderkey").alias("receipt"), F.col("o_custkey").alias("corp"), F.year("o_orderdate").cast("long").alias("fy"), F.col("o_orderdate").alias("filed_at"), money("o_totalprice").alias("value"), state.alias("state"))


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corp, fy, n_filings, value (decimal)."""
    return filings(spark, sf_dir).groupBy("corp", "fy").agg(F.count("*").alias("n_filings"), F.sum("value").alias("value"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of filings: receipt, corp, fy, part, supplier, flag, gross, net, tax, discount (decimals). Only these columns are read and shuffled."""
    line = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("receipt"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"),
        money("l_extendedprice").alias("gross"), net().alias("net"), (net() * rate("l_tax")).alias("tax"), rate("l_discount").alias("discount"),
    )
    return line.join(filings(spark, sf_dir).select("receipt", "corp", "fy"), "receipt")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corp, fy, auditor (null: none is known), flag, net, discount (decimal sums), n: what lines come to by company, year, network and flag. One pass over the lines serves fees, history and returns."""
    network = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier"), F.col("n_regionkey").cast("long").alias("auditor"))
    return lines(spark, sf_dir).join(network, "supplier", "left").groupBy("corp", "fy", "auditor", "flag").agg(F.sum("net").alias("net"), F.sum("discount").alias("discount"), F.count("*").alias("n"))


def engagements(active: DataFrame) -> DataFrame:
    """active: of activity(). corp, fy, auditor, audit_fee, non_audit_fee (decimals): one row for each network at work in a company-year."""
    audit = F.when(F.col("flag") == "N", F.col("net")).otherwise(0)
    return active.where("auditor IS NOT NULL").groupBy("corp", "fy", "auditor").agg(F.sum(audit).alias("audit_fee"), F.sum(F.col("net") - audit).alias("non_audit_fee"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child, share: a tree of companies by key, eight to a parent, with some that hold their next sibling, and some their parent."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("corp"), F.floor(F.abs("c_acctbal")).cast("long").alias("balance"))
    above = F.floor(F.col("corp") / 8).cast("long")
    down = c.where("corp > 0").select(above.alias("parent"), F.col("corp").alias("child"), ((50 + F.col("balance") % 50) / F.lit(100.0)).alias("share"))
    back = c.where("corp % 11 = 0 AND corp > 0").select(F.col("corp").alias("parent"), above.alias("child"), F.lit(0.125).alias("share"))
    across = c.where("corp % 5 = 0 AND corp % 8 < 7").select(F.col("corp").alias("parent"), (F.col("corp") + 1).alias("child"), F.lit(0.375).alias("share"))
    return down.unionByName(back).unionByName(across.join(c.select(F.col("corp").alias("child")), "child", "left_semi"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with their place: doc_id, lang, source, pos (from 0), section."""
    lines = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "section"))
    return lines.select("doc_id", "lang", "source", F.col("pos").cast("long").alias("pos"), "section")


def starts(found: DataFrame) -> DataFrame:
    """found: doc_id, pos, length and what else, but no texts: these rows are shuffled. Adds start, in characters."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("start", F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0)).cast("long"))
