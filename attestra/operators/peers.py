"""select_peer_group: by code prefix, by explicit list, or by adaptive size band. The rule comes with the cohort; rules can be composed.

What "adaptive" means is this library's own definition: same industry, nearest in size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.bounds import bounded_keys
from attestra.operators.ranking import with_neighbours
from attestra.tables import joined, materialize, small


def peers_by_prefix(companies: DataFrame, target: int | str, prefix: str) -> DataFrame:
    """target, peer, rule: companies (corp, code) whose code starts with the prefix, but for the target."""
    if not prefix:
        raise ValueError("an empty prefix selects everything")
    return companies.where(F.col("code").startswith(prefix) & (F.col("corp") != target)).select(F.lit(target).cast(companies.schema["corp"].dataType).alias("target"), F.col("corp").alias("peer"), F.lit(f"prefix:{prefix}").alias("rule"))


def peers_by_list(companies: DataFrame, target: int | str, keys: Sequence[int] | Sequence[str]) -> DataFrame:
    """target, peer, rule: the listed companies that exist, but for the target."""
    return companies.where(F.col("corp").isin(bounded_keys(keys)) & (F.col("corp") != target)).select(F.lit(target).cast(companies.schema["corp"].dataType).alias("target"), F.col("corp").alias("peer"), F.lit("explicit").alias("rule"))


def peers_by_size(companies: DataFrame, k: int = 5) -> DataFrame:
    """companies: corp, industry, size. For every company the k of its industry nearest in size: target, peer, rank, distance, rule.

    Sizes are put in order, each once, with its lowest k + 1 keys: the nearest of a company have its own size or one of
    the k sizes before or after it, and a size's higher keys come after k others. So an order within industries takes
    the place of comparing all pairs. Ties go to the lower key. A company of unknown size has no peers and is none.
    """
    companies = companies.where("size IS NOT NULL")
    lowest = companies.withColumn("place", F.row_number().over(Window.partitionBy("industry", "size").orderBy("corp"))).where(F.col("place") <= k + 1)
    sizes = lowest.groupBy("industry", "size").agg(F.array_sort(F.collect_list("corp")).alias("keys"))
    near = with_neighbours(sizes, ["industry"], "size", "keys", k)
    own = F.array(F.struct(F.col("keys").alias("peer"), F.col("size").alias("peer_value")))
    each = F.flatten(F.transform(F.concat("near", own), lambda s: F.transform(s["peer"], lambda p: F.struct(F.abs(F.col("size") - s["peer_value"]).alias("distance"), p.alias("peer")))))
    nearest = near.select("industry", "size", F.slice(F.array_sort(each), 1, k + 1).alias("nearest"))
    found = joined(companies, nearest, ["industry", "size"]).select("corp", F.posexplode(F.slice(F.filter("nearest", lambda p: p["peer"] != F.col("corp")), 1, k)).alias("at", "p"))
    return found.select(F.col("corp").alias("target"), F.col("p.peer").alias("peer"), (F.col("at") + 1).cast("long").alias("rank"), F.col("p.distance").cast("double").alias("distance"), F.lit(f"adaptive:industry,nearest {k}").alias("rule"))


def peers_by_code(companies: DataFrame, targets: DataFrame, digits: int) -> DataFrame:
    """companies and targets: corp, code. target, peer, rule: for each target the companies whose code starts with the same digits."""
    start = F.substring("code", 1, digits)
    wanted = targets.select(F.col("corp").alias("target"), start.alias("prefix"))
    return companies.select("corp", start.alias("prefix")).join(wanted, "prefix").where("corp <> target").select("target", F.col("corp").alias("peer"), F.concat(F.lit("prefix:"), "prefix").alias("rule"))


def cohorts_by_code(companies: DataFrame, digits: int) -> DataFrame:
    """companies: corp, code. One row a company: corp, cohort (the code's first digits), first (the cohort's lowest key), n_peers (others in it), rule. Whoever needs pairs joins on the cohort; a null code is in none."""
    start = F.substring("code", 1, digits)
    members = companies.select("corp", start.alias("cohort"))
    sums = materialize(members.where("cohort IS NOT NULL").groupBy("cohort").agg(F.min("corp").alias("first"), F.count("*").alias("n")), "cohorts")
    out = members.join(small(sums), "cohort", "left")
    return out.select("corp", "cohort", "first", F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_peers"), F.when(F.col("cohort").isNotNull(), F.concat(F.lit("prefix:"), "cohort")).alias("rule"))


def peers_by_band(companies: DataFrame, targets: DataFrame, low: float = 0.8, high: float = 1.25, digits: int = 0) -> DataFrame:
    """companies and targets: corp, industry, size (and code, with digits). target, peer, rule: those of the target's industry whose size is between low and high times the target's.

    digits: those whose code starts with the same digits, too. Sizes are put in steps of a ratio, and a target looks into the steps that its
    band touches: an equi-join on industry, step and digits, not all pairs of an industry, nor of a code.
    """
    if not 0 < low <= high:
        raise ValueError("a band needs 0 < low <= high")
    size = F.col("size").cast("double")
    step = lambda x, slack=0.0: F.when(x > 0, F.floor(F.log(x) / F.log(F.lit(1.25)) + slack)).otherwise(F.lit(-(10**6)))
    start = F.substring("code", 1, digits) if digits else F.lit("")
    wanted = targets.select(F.col("corp").alias("target"), "industry", start.alias("start"), (size * low).alias("low"), (size * high).alias("high"))
    wanted = wanted.withColumn("step", F.explode(F.sequence(step(F.col("low"), -1e-9), step(F.col("high"), 1e-9))))
    sized = companies.select("corp", "industry", start.alias("start"), size.alias("size"), step(size).alias("step"))
    found = joined(sized, wanted, ["industry", "step", "start"]).where(F.col("size").between(F.col("low"), F.col("high")) & (F.col("corp") != F.col("target")))
    return found.select("target", F.col("corp").alias("peer"), F.concat(F.lit(f"adaptive:industry,size {low:g}-{high:g}" + ("+prefix:" if digits else "")), "start").alias("rule"))


def composed(*cohorts: DataFrame) -> DataFrame:
    """Peers that all rules select, with the rules joined by ``+``."""
    both = reduce(lambda a, b: a.join(b.select("target", "peer", F.col("rule").alias("other")), ["target", "peer"]).withColumn("rule", F.concat_ws("+", "rule", "other")).drop("other"), cohorts)
    return both.select("target", "peer", "rule")
