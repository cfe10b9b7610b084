"""The named operations over a release, with bounded, typed parameters.

Every function takes a Release and returns a DataFrame that carries company, year, receipt
or locator, topic and state where it bears evidence. Definitions that the reference leaves
open (factors, formulas, statuses) are this library's own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.bounds import bounded_keys, bounded_limit, search_term
from attestra.functions.evidence import AVAILABLE, SUMMARY_ONLY, UNAVAILABLE, UNVERIFIED, answer, combined, derived, grid, shown
from attestra.operators import alignment, audit, disclosure, financial, peers, perimeter, search, semantic, similar
from attestra.operators.search import occurrences
from attestra.release import SECTION_KEYS, Release
from attestra.tables import joined

TOOLS: dict[str, Callable[..., DataFrame]] = {}
#: Going-concern factors, from accounts of a release.
CONCERN = ("operating_loss", "negative_cash_flow", "capital_impairment", "low_current_ratio", "high_leverage", "modified_opinion")


def tool(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TOOLS[f.__name__] = f
    return f


#: Columns of the tools that come from a source as they are; what names a row or its source is provenance, and anything else is computed.
FACTS = frozenset("name label value text excerpt target_excerpt original re_reported auditor prior audit_fee non_audit_fee opinion assets type attrs ts event_id net_income operating_cash_flow debt equity n_events format".split())
ABOUT = {"corp": ("corp", "peer", "target", "id"), "fy": ("fy", "fy_after"), "receipt": ("receipt", "receipt_after", "peer_receipt"), "topic": ("topic", "account", "target_topic", "kind"), "state": ("state",)}
ROW = frozenset("corp peer target id fy receipt later_receipt receipt_before receipt_after topic account kind locator start end rule n_cohort state nth rank".split())


def answered(name: str, found: DataFrame) -> DataFrame:
    """What a tool (by its name) found, in four parts: facts, analysis, next_checks, provenance. Tools that part their answers themselves keep theirs.

    Provenance has what names the row and its source, and at least company, year, receipt, topic and state, null where the tool has none; a row
    without a state of its own is as good as what it shows: ``available`` with a receipt, else ``summary_only``. Next checks follow from the state.
    """
    if name not in TOOLS:
        raise ValueError(f"no tool {name}")
    parts = ["facts", "analysis", "next_checks", "provenance"]
    if set(parts) <= set(found.columns):
        return found.select(*parts)
    have = found.columns
    pick = lambda names: next((F.col(c) for c in names if c in have), F.lit(None).cast("string"))
    receipt = pick(ABOUT["receipt"])
    state = F.col("state") if "state" in have else F.when(receipt.isNotNull(), AVAILABLE).otherwise(SUMMARY_ONLY)
    about = {k: pick(names) for k, names in ABOUT.items() if k != "state"} | {"state": state} | {c: F.col(c) for c in have if c in ROW and c not in ABOUT}
    checks = [F.when(state == UNAVAILABLE, F.lit("look for a missing filing")), F.when(state == UNVERIFIED, F.lit("check the source")), F.when((state == SUMMARY_ONLY) & receipt.isNotNull(), F.lit("read the source"))]
    return found.select(*answer({c: F.col(c) for c in have if c in FACTS}, {c: F.col(c) for c in have if c not in FACTS | ROW}, checks, about))


def facts_of(r: Release, corps: Sequence[str] | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """corp, fy, account, value (double), receipt: of several reports of a year, what its own report says, else the next."""
    facts = r["fact"]
    if corps is not None:
        facts = facts.where(F.col("corp").isin(bounded_keys(corps)))
    if years is not None:
        facts = facts.where(F.col("fy").isin(bounded_keys(years)))
    first = F.min_by(F.struct("value", "receipt"), F.struct("reported_in", "receipt"))
    return facts.groupBy("corp", "fy", "account").agg(first.alias("x")).select("corp", "fy", "account", F.col("x.value").cast("double").alias("value"), F.col("x.receipt").alias("receipt"))


def wide(r: Release, accounts: Sequence[str], corps: Sequence[str] | None = None, years: Sequence[int] | None = None) -> DataFrame:
    return financial.financial_snapshot(facts_of(r, corps, years), accounts)


def industries(r: Release, digits: int = 2) -> DataFrame:
    """corp, industry: the first digits of the code."""
    return r["company"].select("corp", F.substring("code", 1, digits).alias("industry"))


def with_cohort(found: DataFrame, values: DataFrame, keys: list[str], corp: str, digits: int) -> DataFrame:
    """Adds rule and n_cohort (companies) of the company's industry."""
    own = values.where(F.col("corp") == corp).select("industry", *keys).distinct()
    sizes = values.join(own, ["industry", *keys], "left_semi").groupBy("industry", *keys).agg(F.countDistinct("corp").alias("n_cohort"))
    rule = F.concat(F.lit(f"industry:{digits} digits:"), F.col("industry"))
    return found.join(sizes.select(*keys, rule.alias("rule"), "n_cohort"), keys, "left")


def known(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.lit(AVAILABLE)).otherwise(F.lit(UNAVAILABLE))


# companies and search


@tool
def search_company(r: Release, query: str, limit: int = 20, typos: int = 2) -> DataFrame:
    """Names that contain the query, and names within two edits of it (see search.search_company)."""
    return search.search_company(r["company"], query, limit, typos)


@tool
def search_dataset(r: Release, query: str, limit: int = 100) -> DataFrame:
    """Companies, sections, notes and disclosures with the term: kind, id, label, score."""
    kinds = [
        ("company", r["company"].select(F.col("corp").alias("id"), F.col("name").alias("label"), F.col("name").alias("text"))),
        ("section", r["section"].where(F.col("state") == AVAILABLE).select(F.col("receipt").alias("id"), F.col("topic").alias("label"), "text", F.col("start").alias("at"))),
        ("note", r["note"].where(F.col("state") == AVAILABLE).select(F.col("receipt").alias("id"), F.col("topic").alias("label"), F.col("excerpt").alias("text"), F.col("locator.start").alias("at"))),
        ("disclosure", r["disclosure"].select(F.col("event_id").alias("id"), F.col("type").alias("label"), F.concat_ws(" ", "type", "attrs").alias("text"))),
    ]
    return search.search_dataset(kinds, query, limit)


@tool
def select_peer_group(r: Release, target: str, prefix: str | None = None, members: Sequence[str] | None = None, nearest: int | None = None, account: str = "assets", fy: int | None = None) -> DataFrame:
    """target, peer, rule. Rules that are given hold together; nearest: that many of the same industry by the account's latest value (of the year fy)."""
    cohorts = []
    if prefix is not None:
        cohorts.append(peers.peers_by_prefix(r["company"], target, prefix))
    if members is not None:
        cohorts.append(peers.peers_by_list(r["company"], target, members))
    if nearest is not None:
        sizes = facts_of(r, years=[fy] if fy else None).where(F.col("account") == account).groupBy("corp").agg(F.max_by("value", "fy").alias("size"))
        cohorts.append(peers.peers_by_size(industries(r).join(sizes, "corp"), bounded_limit(nearest)).where(F.col("target") == target).select("target", "peer", "rule"))
    if not cohorts:
        raise ValueError("a cohort needs a prefix, members or nearest")
    return peers.composed(*cohorts)


# financial


@tool
def get_financial_snapshot(r: Release, corp: str, fy: int, accounts: Sequence[str]) -> DataFrame:
    """A row for each account asked for: corp, fy, account, value, receipt, state."""
    asked = grid(r["company"].where(F.col("corp") == corp).select("corp"), [fy], bounded_keys(accounts)).withColumnRenamed("topic", "account")
    return asked.join(facts_of(r, [corp], [fy]), ["corp", "fy", "account"], "left").withColumn("state", known("value"))


@tool
def compare_to_industry(r: Release, corp: str, account: str, fy: int, digits: int = 2) -> DataFrame:
    """pct, median and gap, with the cohort: its rule and how many companies of it have the value."""
    values = facts_of(r, years=[fy]).where(F.col("account") == account).join(industries(r, digits), "corp")
    ranked = financial.compare_to_industry(values.select("corp", "fy", "industry", "value"))
    return with_cohort(ranked.where(F.col("corp") == corp), values, ["fy"], corp, digits).withColumn("state", F.lit(SUMMARY_ONLY))


@tool
def compare_to_industry_multi(r: Release, corp: str, accounts: Sequence[str], fy: int, digits: int = 2) -> DataFrame:
    values = wide(r, bounded_keys(accounts), years=[fy]).join(industries(r, digits), "corp")
    ranked = financial.compare_to_industry_multi(values, accounts)
    return with_cohort(ranked.where(F.col("corp") == corp), values, ["fy"], corp, digits).withColumn("state", derived(known("value")))


@tool
def get_quality_of_earnings_pack(r: Release, corp: str, years: Sequence[int]) -> DataFrame:
    """Cash flow from operations to net income, growth of income, mean conversion: corp, fy, conversion, yoy, avg3, state; and the four parts of an answer."""
    values = wide(r, ["net_income", "operating_cash_flow"], [corp], years).select("corp", "fy", F.col("net_income").alias("gross"), F.col("operating_cash_flow").alias("net"))
    found = financial.quality_of_earnings(values).join(values, ["corp", "fy"]).join(receipts_of(r), ["corp", "fy"], "left")
    parts = answer(
        {"net_income": F.col("gross"), "operating_cash_flow": F.col("net")},
        {c: F.col(c) for c in ("conversion", "yoy", "avg3")},
        [F.when(F.col("conversion") < 0.8, F.lit("compare receivables with revenue")), F.when(F.col("yoy") < 0, F.lit("compare with the industry"))],
        {"corp": F.col("corp"), "fy": F.col("fy"), "receipt": F.col("receipt"), "topic": F.lit("quality of earnings"), "state": derived(known("conversion"))},
    )
    return found.select("corp", "fy", "conversion", "yoy", "avg3", derived(known("conversion")).alias("state"), *parts)


def receipts_of(r: Release) -> DataFrame:
    """corp, fy, receipt: the latest filing of a year."""
    return r["filing"].groupBy("corp", "fy").agg(F.max_by("receipt", F.struct("filed_at", "receipt")).alias("receipt"))


@tool
def get_dcf_input_candidates(r: Release, corp: str, last: int) -> DataFrame:
    values = wide(r, ["revenue", "tax", "pre_tax_income"], [corp], list(range(last - 2, last + 1)))
    return financial.dcf_inputs(values.select("corp", "fy", F.col("revenue").alias("value"), "tax", F.col("pre_tax_income").alias("net")), last)


@tool
def get_investor_signals(r: Release, corp: str, years: Sequence[int]) -> DataFrame:
    """corp, fy, facts, analysis, next_checks, provenance: the parts of an answer, apart."""
    money = wide(r, ["net_income", "operating_cash_flow", "debt", "equity"], [corp], years)
    events = r["disclosure"].where(F.col("corp") == corp).groupBy("corp", F.year("ts").alias("fy")).agg(F.count("*").alias("n_events"))
    receipts = receipts_of(r)
    rows = grid(r["company"].where(F.col("corp") == corp).select("corp"), bounded_keys(years)).join(money, ["corp", "fy"], "left").join(events, ["corp", "fy"], "left").join(receipts, ["corp", "fy"], "left")
    conversion, leverage = F.try_divide("operating_cash_flow", "net_income"), F.try_divide("debt", "equity")
    parts = answer(
        {c: F.col(c) for c in ("net_income", "operating_cash_flow", "debt", "equity", "n_events")},
        {"cash_conversion": conversion, "leverage": leverage, "low_conversion": conversion < 0.8, "high_leverage": leverage > 2},
        [F.when(conversion < 0.8, F.lit("compare receivables with revenue")), F.when(leverage > 2, F.lit("read the borrowings note")), F.when(F.col("net_income").isNull(), F.lit("look for a missing filing"))],
        {"corp": F.col("corp"), "fy": F.col("fy"), "receipt": F.col("receipt"), "topic": F.lit("investor signals"), "state": derived(combined(known("net_income"), known("equity")))},
    )
    return rows.select("corp", "fy", *parts)


# disclosures


@tool
def search_disclosure_events(r: Release, types: Sequence[str], since: str, until: str, corp: str | None = None, limit: int = 100) -> DataFrame:
    events = r["disclosure"] if corp is None else r["disclosure"].where(F.col("corp") == corp)
    return disclosure.search_disclosure_events(events, types, since, until, limit)


@tool
def fetch_disclosure_on_demand(r: Release, receipts: Sequence[str]) -> DataFrame:
    """What the release holds of these receipts. Nothing is fetched, no key is taken."""
    asked = r.spark.createDataFrame([(x,) for x in bounded_keys(receipts)], "receipt string")
    return disclosure.disclosure_lookup(asked, r["filing"].withColumn("state", F.lit(AVAILABLE)))


# audit risk


def concern_factors(r: Release, corps: Sequence[str] | None, years: Sequence[int]) -> DataFrame:
    names = ["operating_income", "operating_cash_flow", "equity", "capital", "current_assets", "current_liabilities", "debt"]
    company = r["company"].select("corp") if corps is None else r["company"].where(F.col("corp").isin(bounded_keys(corps))).select("corp")
    opinions = r["engagement"].groupBy("corp", "fy").agg(F.max(F.col("opinion") != "unqualified").alias("modified_opinion"))
    rows = grid(company, bounded_keys(years)).join(wide(r, names, corps, years), ["corp", "fy"], "left").join(opinions, ["corp", "fy"], "left")
    return rows.select(
        "corp",
        "fy",
        (F.col("operating_income") < 0).alias("operating_loss"),
        (F.col("operating_cash_flow") < 0).alias("negative_cash_flow"),
        (F.col("equity") < F.col("capital")).alias("capital_impairment"),
        (F.try_divide("current_assets", "current_liabilities") < 1).alias("low_current_ratio"),
        ((F.col("equity") <= 0) | (F.try_divide("debt", "equity") > 4)).alias("high_leverage"),
        "modified_opinion",
    )


@tool
def score_going_concern(r: Release, corp: str, years: Sequence[int]) -> DataFrame:
    """points, evaluated, missing, state; and the parts of an answer: factors as facts, the score as analysis, missing factors as next checks."""
    factors = concern_factors(r, [corp], years)
    found = factors.join(audit.score_going_concern(factors, CONCERN), ["corp", "fy"]).join(receipts_of(r), ["corp", "fy"], "left")
    parts = answer(
        {c: F.col(c) for c in CONCERN},
        {c: F.col(c) for c in ("points", "evaluated", "missing")},
        [F.when(F.col(c).isNull(), F.lit(f"look for what {c} needs")) for c in CONCERN],
        {"corp": F.col("corp"), "fy": F.col("fy"), "receipt": F.col("receipt"), "topic": F.lit("going concern"), "state": F.col("state")},
    )
    return found.select("corp", "fy", "points", "evaluated", "missing", "state", *parts)


@tool
def detect_restatement(r: Release, corp: str, fy: int, later: bool = False, threshold: float = 0.01, known_at: str | None = None) -> DataFrame:
    """A year's accounts as first reported, against the next report (or, if later, the last one): candidates with both receipts. known_at: a moment; what was filed after it isn't known yet."""
    facts = r["fact"].where((F.col("corp") == corp) & (F.col("fy") == fy))
    if known_at is not None:
        facts = facts.join(r["filing"].where(F.col("filed_at") <= F.lit(known_at).cast("timestamp_ntz")), "receipt", "left_semi")
    first = facts.where("reported_in = fy").select(F.col("account").alias("key"), F.col("value").cast("double").alias("value"), "receipt")
    after = facts.where("reported_in > fy" if later else "reported_in = fy + 1").groupBy(F.col("account").alias("key")).agg(F.max_by(F.struct("value", "receipt"), "reported_in").alias("x"))
    after = after.select("key", F.col("x.value").cast("double").alias("value"), F.col("x.receipt").alias("later_receipt"))
    found = audit.detect_restatement(first, after, threshold)
    return found.join(first.select("key", "receipt"), "key").join(after.select("key", "later_receipt"), "key", "left").select(F.lit(corp).alias("corp"), F.lit(fy).alias("fy"), F.col("key").alias("account"), "original", "re_reported", "gap", "candidate", "receipt", "later_receipt", "state")


@tool
def build_audit_acceptance_pack(r: Release, corp: str, years: Sequence[int]) -> DataFrame:
    candidates = [detect_restatement(r, corp, y).groupBy("corp", "fy").agg(F.count(F.when(F.col("candidate"), 1)).alias("candidates")) for y in bounded_keys(years)]
    history = get_audit_history(r, corp)
    fees = r["engagement"].where(F.col("corp") == corp).groupBy("corp", "fy").agg(F.try_divide(F.sum("non_audit_fee").cast("double"), F.sum("audit_fee").cast("double")).alias("ratio"))
    return audit.acceptance_pack(score_going_concern(r, corp, years), reduce(DataFrame.unionByName, candidates), history, fees)


@tool
def estimate_audit_hours_proxy(r: Release, corp: str, fy: int, digits: int = 2) -> DataFrame:
    """The audit fee that the industry's line of fee on assets gives for the company: a proxy, in money and not in hours."""
    sized = wide(r, ["assets"], years=[fy]).join(industries(r, digits), "corp").join(r["engagement"].select("corp", "fy", "audit_fee"), ["corp", "fy"])
    line = audit.audit_hours_proxy(sized.select("industry", F.col("assets").alias("x"), F.col("audit_fee").alias("y")))
    estimate = F.col("intercept") + F.col("slope") * F.col("assets")
    return sized.where(F.col("corp") == corp).join(line, "industry").select("corp", "fy", "assets", F.col("audit_fee").cast("double").alias("audit_fee"), estimate.alias("expected_fee"), "n", derived(known("slope")).alias("state"))


# auditors


def leads(r: Release, corps: DataFrame | None = None) -> DataFrame:
    engaged = r["engagement"] if corps is None else r["engagement"].join(corps, "corp", "left_semi")
    fee = F.coalesce(F.col("audit_fee"), F.lit(0)) + F.coalesce(F.col("non_audit_fee"), F.lit(0))
    ranked = engaged.withColumn("place", F.row_number().over(Window.partitionBy("corp", "fy").orderBy(fee.desc(), "auditor")))
    return ranked.where("place = 1").select("corp", "fy", "auditor")


@tool
def get_audit_history(r: Release, corp: str) -> DataFrame:
    """auditor, prior, status, tenure; the year's receipt; computed, so summary_only."""
    return audit.audit_history(leads(r).where(F.col("corp") == corp)).join(receipts_of(r), ["corp", "fy"], "left").withColumn("state", F.lit(SUMMARY_ONLY))


@tool
def get_subsidiary_auditors(r: Release, parent: str, fy: int, depth: int | None = 3) -> DataFrame:
    """The perimeter down to ``depth`` levels, or whole (None): parent, corp, fy, auditor, state; no engagement on file is ``unavailable``. Holdings in a circle end by themselves."""
    edges = r["subsidiary"].where(F.col("fy") == fy).select("parent", F.col("child").alias("corp"), "fy")
    holders = r.spark.createDataFrame([(parent,)], "parent string")
    if depth is None or bounded_limit(depth) > 1:
        below = perimeter.perimeter(edges.select("parent", F.col("corp").alias("child"), F.lit(None).cast("double").alias("share")), holders.withColumnRenamed("parent", "root"), None if depth is None else depth - 1)
        holders = holders.union(below.select("corp"))
    return audit.subsidiary_auditors(edges.join(holders, "parent", "left_semi").distinct(), leads(r))


@tool
def get_industry_audit_landscape(r: Release, prefix: str, fy: int, digits: int = 2) -> DataFrame:
    companies = industries(r, digits).where(F.col("industry").startswith(search_term(prefix)))
    fees = r["engagement"].where(F.col("fy") == fy).join(companies, "corp").select("industry", "auditor", (F.coalesce("audit_fee", F.lit(0)) + F.coalesce("non_audit_fee", F.lit(0))).alias("fee"))
    return audit.industry_audit_landscape(fees).withColumn("fy", F.lit(fy)).withColumn("rule", F.lit(f"prefix:{prefix}")).withColumn("state", F.lit(SUMMARY_ONLY))


@tool
def compare_peer_audit_fees(r: Release, cohort: DataFrame, fy: int) -> DataFrame:
    """cohort: of select_peer_group. The target and its peers, with the rule."""
    both = cohort.select(F.col("peer").alias("corp"), "rule").union(cohort.select("target", "rule").distinct())
    fees = r["engagement"].where(F.col("fy") == fy).groupBy("corp", "fy").agg(F.sum("audit_fee").cast("double").alias("audit_fee"), F.sum("non_audit_fee").cast("double").alias("non_audit_fee"))
    rows = both.join(fees, "corp", "left").withColumn("fy", F.lit(fy)).withColumn("industry", F.lit("cohort"))
    compared = audit.compare_peer_audit_fees(rows.where("audit_fee IS NOT NULL")).drop("audit_fee", "non_audit_fee", "fy")
    return rows.join(compared, "corp", "left").select("corp", "fy", "audit_fee", "non_audit_fee", "ratio", "pct", "rule", known("audit_fee").alias("state"))


# audit evidence


@tool
def get_audit_report_sections(r: Release, corp: str, fy: int, topic: str | None = None) -> DataFrame:
    """The sections of a year's audit report (of one topic); one row without a source, ``unavailable``, where there is none."""
    sections = r["section"].where((F.col("corp") == corp) & (F.col("fy") == fy) & (F.col("kind") == "audit"))
    asked = r.spark.range(1).select(F.lit(corp).alias("corp"), F.lit(fy).alias("fy"))
    if topic is not None:
        sections, asked = sections.where(F.col("topic") == topic), asked.withColumn("topic", F.lit(topic))
    found = asked.join(sections, asked.columns, "left").withColumn("state", F.coalesce("state", F.lit(UNAVAILABLE)))
    return found.select("corp", "fy", "receipt", "topic", "start", "end", shown(F.col("text"), F.col("state")).alias("text"), "state")


def _search_kind(r: Release, kind: str, query: str, cohort: DataFrame | None, limit: int, ranked: bool = False) -> DataFrame:
    """ranked: by BM25, from the release's index, which knows words; else by occurrences of the query as it is written, from the texts."""
    if ranked:
        best = r.sections.scores(query, F.col("kind") == kind).drop("n_terms")
        best = best if cohort is None else best.join(cohort.select(F.col("peer").alias("corp")), "corp", "left_semi")
        best = best.orderBy(F.desc("score"), "receipt", "start").limit(bounded_limit(limit))
        # texts of the rows found only
        found = joined(r["section"].where((F.col("kind") == kind) & (F.col("state") == AVAILABLE)), F.broadcast(best), SECTION_KEYS)
        return found.select("corp", "fy", "receipt", "topic", "start", "text", "score", "state").orderBy(F.desc("score"), "receipt", "start")
    sections = r["section"].where((F.col("kind") == kind) & (F.col("state") == AVAILABLE))
    if cohort is not None:
        sections = sections.join(cohort.select(F.col("peer").alias("corp")), "corp", "left_semi")
    hits = sections.select("corp", "fy", "receipt", "topic", "start", "text", occurrences(F.col("text"), query).alias("score"), "state").where("score > 0")
    return hits.orderBy(F.desc("score"), "receipt", "start").limit(bounded_limit(limit))


@tool
def search_audit_report_matters(r: Release, query: str, cohort: DataFrame | None = None, limit: int = 50, ranked: bool = False) -> DataFrame:
    return _search_kind(r, "audit", query, cohort, limit, ranked)


@tool
def search_audit_procedures(r: Release, query: str, cohort: DataFrame | None = None, limit: int = 50, ranked: bool = False) -> DataFrame:
    return _search_kind(r, "procedure", query, cohort, limit, ranked)


@tool
def get_kam_lifecycle(r: Release, corp: str, last: int, topic: str | None = None, reworded: float | None = None) -> DataFrame:
    """entry and exit of each matter, with the receipt that names it; the places in the cycle are computed, so summary_only. reworded: the share of words from which a matter continues one of the year before, in other words (then with prior and similarity)."""
    named = r["kam"].where(F.col("corp") == corp).groupBy("corp", "topic", "fy").agg(F.min("receipt").alias("receipt"))
    if reworded is not None:
        threads = audit.kam_threads(named.drop("receipt"), last, reworded)
        threads = threads if topic is None else threads.where(F.col("topic") == topic)
        return threads.join(named, ["corp", "topic", "fy"]).withColumn("state", F.lit(SUMMARY_ONLY))
    named = named if topic is None else named.where(F.col("topic") == topic)
    return audit.kam_lifecycle(named.drop("receipt"), last).join(named, ["corp", "topic", "fy"]).withColumn("state", F.lit(SUMMARY_ONLY))


# accounting notes


def note_grid(r: Release, corps: DataFrame, years: Sequence[int], topics: Sequence[str]) -> DataFrame:
    """A row for each company, year and topic; several notes on one: the best state, the first receipt."""
    rank = F.array_position(F.array(*map(F.lit, (AVAILABLE, SUMMARY_ONLY, UNVERIFIED, UNAVAILABLE))), F.col("state"))
    best = r["note"].withColumn("place", F.row_number().over(Window.partitionBy("corp", "fy", "topic").orderBy(rank, "receipt"))).where("place = 1")
    rows = grid(corps.select("corp"), bounded_keys(years), bounded_keys(topics)).join(best.drop("place"), ["corp", "fy", "topic"], "left")
    state = F.coalesce("state", F.lit(UNAVAILABLE))
    return rows.select("corp", "fy", "topic", "receipt", "locator", "format", shown(F.col("excerpt"), state).alias("excerpt"), state.alias("state"))


@tool
def get_accounting_policy(r: Release, corp: str, fy: int, topics: Sequence[str]) -> DataFrame:
    return note_grid(r, r["company"].where(F.col("corp") == corp), [fy], topics)


@tool
def compare_peer_accounting_policies(r: Release, cohort: DataFrame, fy: int, topic: str) -> DataFrame:
    """Each peer's note beside the target's: peer, excerpt, target_excerpt, similarity (shared words to all words), rule, state (the worst of both)."""
    corps = cohort.select(F.col("peer").alias("corp")).union(cohort.select("target")).distinct()
    rows = note_grid(r, corps, [fy], [topic])
    theirs = rows.select(F.col("corp").alias("target"), F.col("excerpt").alias("target_excerpt"), F.col("state").alias("target_state"))
    out = cohort.join(rows.withColumnRenamed("corp", "peer"), "peer").join(theirs, "target")
    a, b = (F.array_distinct(F.split(F.lower(c), r"\s+")) for c in ("excerpt", "target_excerpt"))
    similarity = F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
    return out.select("target", "peer", "fy", "topic", "receipt", "locator", "excerpt", "target_excerpt", F.when(F.col("excerpt").isNotNull() & F.col("target_excerpt").isNotNull(), similarity).alias("similarity"), "rule", combined(F.col("state"), F.col("target_state")).alias("state"))


@tool
def compare_peer_accounting_notes(r: Release, cohort: DataFrame, fy: int, topics: Sequence[str], accounts: Sequence[str]) -> DataFrame:
    """Notes and amounts of the target and its peers: corp, fy, topic, excerpt, locator, state, a column for each account, rule."""
    both = cohort.select(F.col("peer").alias("corp"), "rule").union(cohort.select("target", "rule").distinct())
    return note_grid(r, both, [fy], topics).join(wide(r, bounded_keys(accounts), years=[fy]), ["corp", "fy"], "left").join(both, "corp")


@tool
def get_accounting_policy_changes(r: Release, corp: str, topic: str, before: int, after: int) -> DataFrame:
    """Sentences of a note that came and went between two years: corp, topic, added, removed, both receipts, state."""
    rows = note_grid(r, r["company"].where(F.col("corp") == corp), [before, after], [topic])
    of = lambda y, mark: rows.where(F.col("fy") == y).select("corp", "topic", F.split("excerpt", r"(?<=[.!?])\s+").alias(f"lines_{mark}"), F.col("receipt").alias(f"receipt_{mark}"), F.col("state").alias(f"state_{mark}"))
    out = of(before, "before").join(of(after, "after"), ["corp", "topic"])
    return out.select("corp", "topic", F.array_except("lines_after", "lines_before").alias("added"), F.array_except("lines_before", "lines_after").alias("removed"), "receipt_before", "receipt_after", combined(F.col("state_before"), F.col("state_after")).alias("state"))


def get_accounting_policy_spans(r: Release, corp: str, topic: str, before: int, after: int) -> DataFrame:
    """get_accounting_policy_changes, sentence by sentence in order: corp, topic, nth, kind (added, removed, changed, moved), the spans in the section of each year (as its locator counts), both receipts, state. Where one of the notes isn't ``available``, there is no text to compare, and no row."""
    rows = note_grid(r, r["company"].where(F.col("corp") == corp), [before, after], [topic])
    of = lambda y, mark: rows.where((F.col("fy") == y) & (F.col("state") == AVAILABLE)).select("corp", "topic", F.col("excerpt").alias(mark), F.coalesce("locator.start", F.lit(0)).alias(f"{mark}_at"), F.col("receipt").alias(f"receipt_{mark}"))
    pairs = of(before, "before").join(of(after, "after"), ["corp", "topic"])
    keys = ["corp", "topic", "before_at", "after_at", "receipt_before", "receipt_after"]
    found = alignment.aligned_changes(pairs, keys)
    moved = [(F.col(f"{side}_{end}") + F.col(f"{side}_at")).alias(f"{side}_{end}") for side in ("before", "after") for end in ("start", "end")]
    return found.select("corp", "topic", "nth", "kind", *moved, "n_before", "n_after", "receipt_before", "receipt_after", F.lit(SUMMARY_ONLY).alias("state"))


# context


@tool
def get_semantic_company_context(r: Release, corp: str | None = None) -> DataFrame:
    """By company and year: sections by topic, notes, matters, events, accounts; a state that is available if every kind is there."""
    only = lambda df: df if corp is None else df.where(F.col("corp") == corp)
    sections = only(r["section"]).groupBy("corp", "fy").agg(F.sort_array(F.collect_set("topic")).alias("section_topics"))
    notes = only(r["note"]).groupBy("corp", "fy").agg(F.count("*").alias("n_notes"))
    matters = only(r["kam"]).groupBy("corp", "fy").agg(F.sort_array(F.collect_set("topic")).alias("matters"))
    events = only(r["disclosure"]).groupBy("corp", F.year("ts").alias("fy")).agg(F.count("*").alias("n_events"))
    facts = only(r["fact"]).groupBy("corp", "fy").agg(F.countDistinct("account").alias("n_accounts"))
    return semantic.company_context(sections, notes, matters, events, facts)


@tool
def semantic_peer_context_review(r: Release, cohort: DataFrame, fy: int, nearest: int | None = None) -> DataFrame:
    """Each peer's context beside the target's: shared and missing section topics; rule; state.

    nearest: instead, that many of the peers' sections of the year that say the most like each of the target's, by the terms they use:
    target, peer, fy, target_topic, target_receipt, peer_topic, peer_receipt, peer_start, rank, score (cosine), rule, state.
    """
    if nearest is not None:
        own = r["section"].where((F.col("fy") == fy) & (F.col("state") == AVAILABLE)).select(*SECTION_KEYS)
        theirs = own.join(cohort.select(F.col("peer").alias("corp")), "corp", "left_semi")
        mine = own.join(cohort.select(F.col("target").alias("corp")), "corp", "left_semi")
        found = similar.similar(r.sections, mine, bounded_limit(nearest), among=theirs)
        rules = cohort.select(F.col("target").alias("target_corp"), F.col("peer").alias("peer_corp"), "rule")
        pick = [F.col("target_corp").alias("target"), F.col("peer_corp").alias("peer"), F.lit(fy).alias("fy"), "target_topic", "target_receipt", "peer_topic", "peer_receipt", "peer_start", "rank", "score", "rule"]
        return found.join(rules, ["target_corp", "peer_corp"]).select(*pick, F.lit(SUMMARY_ONLY).alias("state"))
    context = get_semantic_company_context(r).where(F.col("fy") == fy)
    mine = context.select(F.col("corp").alias("target"), F.col("section_topics").alias("target_topics"))
    out = cohort.join(context.withColumnRenamed("corp", "peer"), "peer", "left").join(mine, "target", "left")
    return out.select("target", "peer", F.lit(fy).alias("fy"), F.array_intersect("section_topics", "target_topics").alias("shared"), F.array_except("target_topics", "section_topics").alias("missing"), "n_notes", "n_events", "rule", F.coalesce("state", F.lit(UNAVAILABLE)).alias("state"))
