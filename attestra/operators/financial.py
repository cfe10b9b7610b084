"""get_financial_snapshot, compare_to_industry (and multi), get_quality_of_earnings_pack, get_dcf_input_candidates, get_investor_signals.

Formulas the reference doesn't publish are this library's own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.evidence import AVAILABLE, SUMMARY_ONLY, UNAVAILABLE, derived
from attestra.operators.ranking import value_ranks


def normalized_facts(raw: DataFrame, aliases: Mapping[str, str], keys: Sequence[str] = ("corp", "fy")) -> DataFrame:
    """Wide tables whose column names vary by year, as facts in long form: keys, account, value. aliases: column name -> account; columns that are missing are passed over."""
    present = [c for c in aliases if c in raw.columns]
    names = F.create_map(*(F.lit(x) for c in present for x in (c, aliases[c])))
    return raw.unpivot(list(keys), present, "column", "value").where("value IS NOT NULL").select(*keys, names[F.col("column")].alias("account"), "value")


def financial_snapshot(facts: DataFrame, accounts: Sequence[str]) -> DataFrame:
    """facts: corp, fy, account, value. One row for each company and year, a column for each account."""
    return facts.groupBy("corp", "fy").pivot("account", list(accounts)).agg(F.max("value"))


def compare_to_industry(values: DataFrame) -> DataFrame:
    """values: corp, fy, industry, value. Adds pct (percent rank), median and gap, within industry and year."""
    return _compared(values, ["industry", "fy"]).select("corp", "fy", "value", "pct", "median", (F.col("value") - F.col("median")).alias("gap"))


def compare_to_industry_multi(values: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """values: corp, fy, industry and the metrics as columns. One row for each metric: corp, fy, metric, value, pct."""
    long = values.unpivot(["corp", "fy", "industry"], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    return _compared(long, ["industry", "fy", "metric"]).select("corp", "fy", "metric", "value", "pct")


def _compared(values: DataFrame, group: list[str]) -> DataFrame:
    return value_ranks(values, group, "value")


def before(value: str) -> Column:
    """Last year's value, if that year is there: a gap isn't bridged."""
    w = Window.partitionBy("corp").orderBy("fy")
    return F.when(F.lag("fy").over(w) == F.col("fy") - 1, F.lag(value).over(w))


def quality_of_earnings(values: DataFrame, whole: int | None = None) -> DataFrame:
    """values: corp, fy, gross, net (doubles). conversion: net to gross; yoy: growth of net over the year before, up to the last whole year, if one is given; avg3: mean conversion of three years on file."""
    w = Window.partitionBy("corp").orderBy("fy")
    out = values.withColumn("conversion", F.try_divide("net", "gross")).withColumn("prior", before("net"))
    yoy = F.try_divide("net", "prior") - 1
    yoy = yoy if whole is None else F.when(F.col("fy") <= whole, yoy)
    return out.select("corp", "fy", "conversion", yoy.alias("yoy"), F.avg("conversion").over(w.rowsBetween(-2, 0)).alias("avg3"))


def leverage(values: DataFrame, most: float = 2.0) -> DataFrame:
    """values: corp, fy, debt, equity (doubles). leverage: debt to equity (null where that is zero or either is unknown); high: over ``most``, or no equity left where there is debt; state."""
    ratio = F.try_divide("debt", "equity")
    known = F.col("debt").isNotNull() & F.col("equity").isNotNull()
    high = F.when(known, (F.col("debt") > 0) & (F.col("equity") <= 0) | F.coalesce(ratio > most, F.lit(False)))
    return values.select("corp", "fy", "debt", "equity", ratio.alias("leverage"), high.alias("high"), F.when(known, SUMMARY_ONLY).otherwise(UNAVAILABLE).alias("state"))


def dcf_inputs(values: DataFrame, last: int) -> DataFrame:
    """values: corp, fy, value, tax, net (decimals). Candidate inputs, no valuation: corp, input, value, state. From the three years up to ``last``."""
    years = values.where(F.col("fy").between(last - 2, last)).groupBy("corp").agg(
        F.try_divide(F.sum("value").cast("double"), F.count("*")).alias("mean_value"),
        (F.try_divide(F.sum(F.when(F.col("fy") == last, F.col("value"))).cast("double"), F.sum(F.when(F.col("fy") == last - 2, F.col("value"))).cast("double")) - 1).alias("growth"),
        F.try_divide(F.sum("tax").cast("double"), F.sum("net").cast("double")).alias("tax_share"),
    )
    long = years.unpivot(["corp"], ["mean_value", "growth", "tax_share"], "input", "value")
    return long.select("corp", "input", "value", derived(F.when(F.col("value").isNotNull(), AVAILABLE)).alias("state"))


def investor_signals(quality: DataFrame) -> DataFrame:
    """quality: corp, fy, conversion, yoy, avg3, n_filings. Signals in long form: corp, fy, signal, flag (null: not known), next_check where raised."""
    signals = {
        "low_conversion": (F.col("conversion") < 0.94, "read the revenue recognition note"),
        "declining": (F.col("yoy") < 0, "compare with the industry"),
        "below_own_average": (F.col("conversion") < F.col("avg3"), "look at the latest events"),
        "single_filing": (F.col("n_filings") == 1, "look for missing filings"),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("signal"), flag.alias("flag"), F.when(flag, F.lit(check)).alias("next_check")) for k, (flag, check) in signals.items()))
    return quality.select("corp", "fy", F.explode(rows).alias("s")).select("corp", "fy", "s.*")
