"""score_going_concern, detect_restatement, build_audit_acceptance_pack, estimate_audit_hours_proxy, get_audit_history, get_subsidiary_auditors, get_industry_audit_landscape, compare_peer_audit_fees, get_kam_lifecycle.

Factors, formulas and statuses that the reference doesn't publish are this library's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.evidence import AVAILABLE, SUMMARY_ONLY, UNAVAILABLE, combined
from attestra.operators.ranking import value_ranks
from attestra.operators.text_index import terms_of
from attestra.tables import joined, materialize

#: Of the driver tables.
FACTORS = ("negative_balance", "decline", "gap", "high_returns", "high_discount", "no_recent_filing")


def score_going_concern(factors: DataFrame, names: Sequence[str] = FACTORS) -> DataFrame:
    """factors: corp, fy, and the named factors as booleans. points: those raised; a null factor is missing, never passed. state: summary_only if all are evaluated, unavailable if none is, else unverified."""
    count = lambda test: sum((F.when(test(F.col(f)), 1).otherwise(0) for f in names), F.lit(0)).cast("long")
    missing = count(lambda c: c.isNull())
    state = F.when(missing == 0, SUMMARY_ONLY).when(missing == len(names), UNAVAILABLE).otherwise("unverified")
    return factors.select("corp", "fy", count(lambda c: c).alias("points"), (len(names) - missing).alias("evaluated"), missing.alias("missing"), state.alias("state"))


def detect_restatement(originals: DataFrame, later: DataFrame, threshold: float = 0.01, keep: Sequence[str] = ()) -> DataFrame:
    """originals and later: key, value (double). Candidates, not findings: key, columns to keep of originals, original, re_reported, gap (relative), candidate, state. A gap is computed, so it is summary_only at best."""
    both = originals.select("key", *keep, F.col("value").alias("original")).join(later.select("key", F.col("value").alias("re_reported")), "key", "left")
    gap = F.try_divide(F.col("re_reported") - F.col("original"), F.abs("original"))
    return both.withColumn("gap", gap).select("key", *keep, "original", "re_reported", "gap", (F.abs("gap") > threshold).alias("candidate"), F.when(F.col("re_reported").isNotNull(), SUMMARY_ONLY).otherwise(UNAVAILABLE).alias("state"))


def audit_hours_proxy(values: DataFrame, group: str = "industry") -> DataFrame:
    """values: group, x (count), y (decimal). Least squares of y on x in each group, from exact sums: group, n, slope, intercept."""
    sums = values.groupBy(group).agg(F.count("*").alias("n"), F.sum("x").cast("double").alias("sx"), F.sum(F.col("x") * F.col("x")).cast("double").alias("sxx"), F.sum("y").cast("double").alias("sy"), F.sum(F.col("x") * F.col("y")).cast("double").alias("sxy"))
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return sums.withColumn("slope", slope).select(group, "n", "slope", F.try_divide(F.col("sy") - F.col("slope") * F.col("sx"), F.col("n")).alias("intercept"))


def lead_auditors(engagements: DataFrame) -> DataFrame:
    """corp, fy, auditor: the one with the highest fee in a year, the lower key among equals."""
    fee = F.col("audit_fee") + F.col("non_audit_fee")
    return engagements.groupBy("corp", "fy").agg(F.max_by("auditor", F.struct(fee, -F.col("auditor"))).alias("auditor"))


def audit_history(leads: DataFrame) -> DataFrame:
    """leads: corp, fy, auditor. prior: the one on file before; status: first, retained or changed; tenure: years on file in a row with this one, gaps in years included."""
    w = Window.partitionBy("corp").orderBy("fy")
    prior = F.lag("auditor").over(w)
    status = F.when(prior.isNull(), "first").when(prior == F.col("auditor"), "retained").otherwise("changed")
    out = leads.withColumn("prior", prior).withColumn("status", status).withColumn("island", F.sum(F.when(F.col("status") == "changed", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tenure = F.row_number().over(Window.partitionBy("corp", "island").orderBy("fy")).cast("long")
    return out.select("corp", "fy", "auditor", "prior", "status", tenure.alias("tenure"))


def subsidiary_auditors(perimeter: DataFrame, leads: DataFrame) -> DataFrame:
    """perimeter: parent, corp, fy (all that should be there). parent, corp, fy, auditor, state; a subsidiary without evidence is ``unavailable``."""
    return perimeter.join(leads, ["corp", "fy"], "left").select("parent", "corp", "fy", "auditor", F.when(F.col("auditor").isNotNull(), AVAILABLE).otherwise(UNAVAILABLE).alias("state"))


def missing_evidence(perimeter: DataFrame, found: DataFrame) -> DataFrame:
    """perimeter: corp, fy and more. Its rows for which nothing was found."""
    return perimeter.join(found, ["corp", "fy"], "left_anti")


def auditor_matrix(found: DataFrame, auditors: list[int]) -> DataFrame:
    """found: as of subsidiary_auditors. parent, fy, a count for each auditor, and missing."""
    counts = [F.count(F.when(F.col("auditor") == a, 1)).alias(f"auditor_{a}") for a in auditors]
    return found.groupBy("parent", "fy").agg(*counts, F.count(F.when(F.col("state") == UNAVAILABLE, 1)).alias("missing"))


def industry_audit_landscape(fees: DataFrame) -> DataFrame:
    """fees: industry, auditor, fee (decimal). Rolled up: share of the industry's fees and rank within it; nulls are totals."""
    rolled = fees.rollup("industry", "auditor").agg(F.sum("fee").alias("fee"), F.grouping_id().cast("long").alias("level"))
    total = F.sum(F.when(F.col("level") == 1, F.col("fee"))).over(Window.partitionBy("industry"))
    rank = F.when(F.col("level") == 0, F.dense_rank().over(Window.partitionBy("industry", "level").orderBy(F.desc("fee"))).cast("long"))
    out = rolled.withColumn("share", F.when(F.col("level") == 0, F.try_divide(F.col("fee").cast("double"), total.cast("double")))).withColumn("rank", rank)
    return out.select("industry", "auditor", F.col("fee").cast("double").alias("fee"), "share", "rank", "level")


def compare_peer_audit_fees(fees: DataFrame) -> DataFrame:
    """fees: corp, fy, industry, audit_fee, non_audit_fee (doubles). ratio of non-audit to audit fee, percent rank of the audit fee among peers of the year."""
    return value_ranks(fees, ["industry", "fy"], "audit_fee").select("corp", "fy", "audit_fee", "non_audit_fee", F.try_divide("non_audit_fee", "audit_fee").alias("ratio"), "pct")


def kam_lifecycle(topics: DataFrame, last: int) -> DataFrame:
    """topics: corp, topic, fy (distinct). entry: new, continued or returned; exit: kept, dropped, or open in the last year."""
    w = Window.partitionBy("corp", "topic").orderBy("fy")
    prior, following = F.lag("fy").over(w), F.lead("fy").over(w)
    entry = F.when(prior.isNull(), "new").when(prior == F.col("fy") - 1, "continued").otherwise("returned")
    leaving = F.when(F.col("fy") == last, "open").when(following == F.col("fy") + 1, "kept").otherwise("dropped")
    return topics.select("corp", "topic", "fy", entry.alias("entry"), leaving.alias("exit"))


def threaded(now: Column, before: Column, least: float) -> Column:
    """now and before: arrays of (topic, words). topic, prior, similarity of each pair taken, the most similar first, one to one."""

    def alike(t: Column) -> Column:
        def pair(p: Column) -> Column:
            shared = F.size(F.array_intersect(t["words"], p["words"]))
            return F.struct((-(shared / (F.size(t["words"]) + F.size(p["words"]) - shared))).alias("far"), (t["topic"] != p["topic"]).alias("other"), p["topic"].alias("prior"), t["topic"].alias("topic"))

        return F.filter(F.transform(before, pair), lambda x: (x["far"] <= -least) & (x["far"] < 0))

    taken = F.filter(F.array(F.struct(F.lit(0.0).alias("far"), F.lit(False).alias("other"), F.lit("").alias("prior"), F.lit("").alias("topic"))), lambda _: F.lit(False))
    free = lambda out, p: ~F.exists(out, lambda x: (x["prior"] == p["prior"]) | (x["topic"] == p["topic"]))
    return F.aggregate(F.array_sort(F.flatten(F.transform(now, alike))), taken, lambda out, p: F.when(free(out, p), F.array_append(out, p)).otherwise(out))


def kam_threads(topics: DataFrame, last: int, least: float = 0.5) -> DataFrame:
    """topics: corp, topic, fy. Which matter of the year before each continues, whatever its wording: corp, fy, topic, prior (its wording then), similarity (shared words to all words), entry (new, continued: in the same words, or reworded), exit (kept, dropped, or open in the last year).

    Matters of a company meet where they share a word (or are the same). Of those with a similarity of ``least`` or more, the most similar pair
    is taken first (of equals, the same wording, then the lower names), then the next of which neither has a partner: one to one. A matter without a
    name, or of no known company or year, has no partner. Topics are shuffled once, by company; what is gathered is one company-year's
    matters and its pairs, and years meet in a window. Repeated topics count once.
    """
    w = Window.partitionBy("corp").orderBy("fy")
    said = topics.select("corp", "fy", F.struct("topic").alias("t")).repartition("corp").groupBy("corp", "fy").agg(F.collect_set("t").alias("all"))

    def worded(t: Column) -> Column:
        words = F.array_distinct(terms_of(t["topic"]))
        return F.struct(t["topic"].alias("topic"), F.when(F.size(words) > 0, words).otherwise(F.array(t["topic"])).alias("words"))

    said = said.withColumn("now", F.transform(F.filter("all", lambda t: t["topic"].isNotNull() & F.col("corp").isNotNull()), worded))
    met = said.withColumn("before", F.when(F.lag("fy").over(w) == F.col("fy") - 1, F.lag("now").over(w)))
    linked = met.select("corp", "fy", "all", threaded(F.col("now"), F.coalesce("before", F.filter("now", lambda _: F.lit(False))), least).alias("links"))
    linked = linked.withColumn("next", F.when(F.lead("fy").over(w) == F.col("fy") + 1, F.lead("links").over(w)))
    each = linked.select("corp", "fy", "links", "next", F.explode("all").alias("t")).select("corp", "fy", "links", "next", F.col("t.topic").alias("topic"))
    link = F.get(F.filter("links", lambda x: x["topic"] == F.col("topic")), F.lit(0))
    out = each.select("corp", "fy", "topic", link.alias("link"), F.exists("next", lambda x: x["prior"] == F.col("topic")).alias("goes_on"))
    out = out.select("corp", "fy", "topic", F.col("link.prior").alias("prior"), (-F.col("link.far")).alias("similarity"), "goes_on")
    entry = F.when(F.col("prior").isNull(), "new").when(F.col("prior") == F.col("topic"), "continued").otherwise("reworded")
    leaving = F.when(F.col("fy") == last, "open").when(F.col("goes_on"), "kept").otherwise("dropped")
    return out.select("corp", "fy", "topic", "prior", "similarity", entry.alias("entry"), leaving.alias("exit"))


#: Standard errors from a threshold within which an estimate of companies isn't relied on, and the buckets (a power of two) of their sketches.
NEAR_ERRORS, LG_BUCKETS = 5, 12


def market_cells(engagements: DataFrame) -> DataFrame:
    """engagements: fy, industry, auditor, corp, fee (decimal). One row a cell of the finest grain, with a sketch of its companies: what a stored release needs for any cube."""
    return engagements.groupBy("fy", "industry", "auditor").agg(F.sum("fee").alias("fee"), F.count("*").alias("n"), F.hll_sketch_agg("corp", LG_BUCKETS).alias("companies"))


def market_cube(engagements: DataFrame, least: int = 10, cells: DataFrame | None = None) -> DataFrame:
    """The audit market by all sets of year, industry and auditor: fy, industry, auditor, level (bits of what is summed over), fee, n, and whether it has ``least`` companies or more, so that a figure tells of no single one (reported).

    cells: of market_cells, written, if there are any. Cells roll up: sums are added and sketches merged, so engagements are read for the cells
    only, and once more for those sets in which an estimate is so near to ``least`` that companies are counted themselves.
    """
    dims = ["fy", "industry", "auditor"]
    cells = materialize(market_cells(engagements), "market-cells") if cells is None else cells
    cube = cells.cube(*dims).agg(F.grouping_id().cast("long").alias("level"), F.sum("fee").alias("fee"), F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("companies")).alias("estimate"))
    cube = materialize(cube, "market-cube")
    error = NEAR_ERRORS * 1.04 / 2 ** (LG_BUCKETS / 2)
    near = cube.where(F.col("estimate").between(least * (1 - error) - 1, least * (1 + error) + 1)).select(*dims, "level")
    exact = None
    for level in sorted(r.level for r in near.select("level").distinct().collect()):  # eight at most
        own = [d for i, d in enumerate(dims) if not level >> (len(dims) - 1 - i) & 1]
        rows = engagements.select(*own, "corp").distinct()
        rows = joined(rows, near.where(F.col("level") == level).select(*own, F.lit(True).alias("near")), own) if own else rows
        counts = rows.groupBy(*own).agg(F.count("corp").alias("companies"))
        counts = counts.select(*(F.col(d) if d in own else F.lit(None).cast(cube.schema[d].dataType).alias(d) for d in dims), F.lit(level).cast("long").alias("level"), "companies")
        exact = counts if exact is None else exact.unionByName(counts)
    counted = joined(cube, exact, [*dims, "level"], "left") if exact is not None else cube.withColumn("companies", F.lit(None).cast("long"))
    return counted.select(*dims, "level", F.col("fee").cast("double").alias("fee"), "n", (F.coalesce("companies", "estimate") >= least).alias("reported"))


def acceptance_pack(concern: DataFrame, restated: DataFrame, history: DataFrame, fees: DataFrame) -> DataFrame:
    """One row for each company and year of concern: points, candidates, auditor, status, ratio. Its state is the worst of its parts'."""
    out = concern.join(restated, ["corp", "fy"], "left").join(history.select("corp", "fy", "auditor", "status"), ["corp", "fy"], "left").join(fees.select("corp", "fy", "ratio"), ["corp", "fy"], "left")
    state = combined(F.col("state"), F.when(F.col("candidates").isNotNull(), AVAILABLE), F.when(F.col("auditor").isNotNull(), AVAILABLE))
    return out.select("corp", "fy", "points", "candidates", "auditor", "status", "ratio", state.alias("state"))
