"""All named operations over a small invented release with gaps, ties, nulls and Korean text."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest

from attestra import catalog as c
from attestra.release import SCHEMAS, Release

T = datetime.datetime


@pytest.fixture(scope="module")
def release(spark):
    companies = [("001", "가람전자", "2611"), ("002", "Alpha Chips", "2612"), ("003", "Alphabet Soup", "2620"), ("004", "Beta", "4711"), ("005", "Gamma Chips", "2611")]
    filings = [(f"r{corp}{fy}", corp, fy, "annual", T(fy + 1, 3, 31)) for corp in ("001", "002", "003") for fy in (2021, 2022, 2023)]
    accounts = {"revenue": 100, "net_income": 10, "operating_cash_flow": 12, "operating_income": 15, "equity": 50, "capital": 20, "current_assets": 30, "current_liabilities": 20, "debt": 60, "assets": 110, "tax": 2, "pre_tax_income": 12}
    facts = []
    for i, corp in enumerate(("001", "002", "003")):
        for fy in (2021, 2022, 2023):
            facts += [(corp, fy, fy, a, Decimal(v * (i + 1) + fy - 2021), f"r{corp}{fy}") for a, v in accounts.items()]
    facts += [("001", 2021, 2022, "revenue", Decimal(150), "r0012022"), ("001", 2021, 2022, "tax", Decimal(2), "r0012022"), ("001", 2021, 2023, "tax", Decimal(9), "r0012023"), ("005", 2023, 2023, "equity", Decimal(-5), "r0052023"), ("005", 2023, 2023, "capital", Decimal(5), "r0052023"), ("005", 2023, 2023, "assets", None, "r0052023")]
    sections = [("r0012023", "001", 2023, "audit", "opinion", "적정 의견. lease lease", 0, 20, "available"), ("r0012023", "001", 2023, "audit", "kam", "secret", 21, 30, "summary_only"), ("r0022023", "002", 2023, "audit", "opinion", "Lease review", 0, 12, "available"), ("r0022023", "002", 2023, "procedure", "kam", "We tested leases", 0, 16, "available")]
    notes = [("r0012022", "001", 2022, "leases", "Old rule. Same rule.", ("n1", 0, 20), {"bold": "1"}, "available"), ("r0012023", "001", 2023, "leases", "Same rule. New rule!", ("n1", 0, 20), {}, "available"), ("r0012023b", "001", 2023, "leases", "worse", None, None, "unverified"), ("r0022023", "002", 2023, "leases", "Same thing", ("n2", 5, 15), {}, "available"), ("r0032023", "003", 2023, "leases", "hidden", ("n3", 1, 2), {}, "unverified")]
    engagements = [("001", 2021, "A", Decimal(100), Decimal(50), "unqualified"), ("001", 2022, "B", Decimal(100), None, "unqualified"), ("001", 2023, "B", Decimal(120), Decimal(0), "qualified"), ("002", 2023, "A", Decimal(200), Decimal(20), "unqualified"), ("003", 2023, "C", Decimal(300), Decimal(300), None)]
    tables = {
        "company": companies,
        "filing": filings,
        "fact": facts,
        "section": sections,
        "note": notes,
        "engagement": engagements,
        "subsidiary": [("001", "002", 2023), ("002", "004", 2023), ("001", "005", 2023), ("004", "001", 2023)],
        "kam": [("001", 2021, "revenue", "r0012021"), ("001", 2023, "revenue", "r0012023"), ("001", 2023, "leases", "r0012023")],
        "disclosure": [("e1", "001", T(2023, 5, 1), "merger", "{}"), ("e2", "001", T(2023, 5, 1), "merger", "broken {"), ("e3", "002", T(2023, 6, 1), "lawsuit", None)],
    }
    return Release(spark, {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in tables.items()})


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows(df)}


def test_there_are_29():
    assert len(c.TOOLS) == 29


def test_search(release):
    assert [r["corp"] for r in rows(c.search_company(release, "alpha"))] == ["003", "002"] or [r["corp"] for r in rows(c.search_company(release, "alpha"))] == ["002", "003"]
    assert [r["corp"] for r in rows(c.search_company(release, "가람"))] == ["001"]
    found = rows(c.search_dataset(release, "lease"))
    assert found[0]["kind"] == "section" and found[0]["score"] == 2
    assert not any(r["label"] == "kam" and r["id"] == "r0012023" for r in rows(c.search_dataset(release, "secret")))


def test_peers(release):
    assert {r["peer"] for r in rows(c.select_peer_group(release, "001", prefix="26"))} == {"002", "003", "005"}
    both = rows(c.select_peer_group(release, "001", prefix="261", members=["002", "004"]))
    assert both == [{"target": "001", "peer": "002", "rule": "prefix:261+explicit"}]
    assert [r["peer"] for r in rows(c.select_peer_group(release, "001", nearest=1))] == ["002"]
    with pytest.raises(ValueError):
        c.select_peer_group(release, "001")


def test_snapshot_has_a_row_for_what_is_missing(release):
    got = by(c.get_financial_snapshot(release, "001", 2023, ["revenue", "goodwill"]), "account")
    assert got["revenue"]["state"] == "available" and got["revenue"]["receipt"] == "r0012023" and got["goodwill"]["state"] == "unavailable"


def test_original_figures_come_first(release):
    assert by(c.get_financial_snapshot(release, "001", 2021, ["revenue"]), "account")["revenue"]["value"] == 100


def test_industry(release):
    got = rows(c.compare_to_industry(release, "002", "revenue", 2023))[0]
    assert got["pct"] == 0.5 and got["gap"] == 0
    assert {r["metric"] for r in rows(c.compare_to_industry_multi(release, "002", ["revenue", "debt"], 2023))} == {"revenue", "debt"}


def test_earnings_and_dcf(release):
    got = by(c.get_quality_of_earnings_pack(release, "001", [2021, 2022, 2023]), "fy")
    assert got[2021]["conversion"] == 1.2 and got[2021]["yoy"] is None and got[2023]["state"] == "summary_only"
    dcf = by(c.get_dcf_input_candidates(release, "001", 2023), "input")
    assert dcf["growth"]["value"] == pytest.approx(0.02) and dcf["mean_value"]["value"] == 101


def test_signals_keep_parts_apart(release):
    got = by(c.get_investor_signals(release, "001", [2023, 2024]), "fy")
    assert got[2023]["facts"]["n_events"] == 2 and got[2023]["provenance"]["receipt"] == "r0012023" and got[2023]["provenance"]["state"] == "summary_only"
    assert got[2024]["provenance"]["state"] == "unavailable" and got[2024]["next_checks"] == ["look for a missing filing"]


def test_disclosures(release):
    got = rows(c.search_disclosure_events(release, ["merger", "lawsuit"], "2023-05-01", "2023-06-01"))
    assert [r["event_id"] for r in got] == ["e1", "e2"]
    assert by(c.fetch_disclosure_on_demand(release, ["r0012023", "r9"]), "receipt")["r9"]["state"] == "unverified"


def test_going_concern(release):
    got = by(c.score_going_concern(release, "001", [2023, 2024]), "fy")
    assert got[2023]["points"] == 1 and got[2023]["missing"] == 0 and got[2024]["missing"] == 6
    other = rows(c.score_going_concern(release, "005", [2023]))[0]
    assert other["points"] == 2 and other["missing"] == 4 and other["state"] == "unverified"


def test_restatement(release):
    got = by(c.detect_restatement(release, "001", 2021), "account")
    assert got["revenue"]["candidate"] and got["revenue"]["later_receipt"] == "r0012022"
    assert got["tax"]["candidate"] is False and got["equity"]["state"] == "unavailable"
    assert by(c.detect_restatement(release, "001", 2021, later=True), "account")["tax"]["candidate"]


def test_acceptance(release):
    got = by(c.build_audit_acceptance_pack(release, "001", [2022, 2023]), "fy")
    assert got[2022]["status"] == "changed" and got[2022]["candidates"] == 0 and got[2023]["ratio"] == 0


def test_hours_proxy(release):
    got = rows(c.estimate_audit_hours_proxy(release, "002", 2023))[0]
    assert got["n"] == 3 and abs(got["expected_fee"] - 206.67) < 10 and got["state"] == "summary_only"


def test_auditors(release):
    assert [r["status"] for r in rows(c.get_audit_history(release, "001").orderBy("fy"))] == ["first", "changed", "retained"]
    group = by(c.get_subsidiary_auditors(release, "001", 2023), "corp")
    assert set(group) == {"001", "002", "004", "005"} and group["004"]["state"] == "unavailable" and group["002"]["auditor"] == "A"
    land = by(c.get_industry_audit_landscape(release, "26", 2023), "industry", "auditor")
    assert land["26", "C"]["rank"] == 1 and land["26", "C"]["share"] == pytest.approx(600 / 940)


def test_fees(release):
    cohort = c.select_peer_group(release, "001", prefix="26")
    got = by(c.compare_peer_audit_fees(release, cohort, 2023), "corp")
    assert got["003"]["pct"] == 1 and got["001"]["ratio"] == 0 and got["005"]["state"] == "unavailable" and got["005"]["rule"] == "prefix:26"


def test_reports(release):
    got = by(c.get_audit_report_sections(release, "001", 2023), "topic")
    assert got["opinion"]["text"] and got["kam"]["text"] is None and got["kam"]["state"] == "summary_only"
    assert [r["corp"] for r in rows(c.search_audit_report_matters(release, "lease"))] == ["001", "002"]
    cohort = c.select_peer_group(release, "001", prefix="26")
    assert [r["corp"] for r in rows(c.search_audit_report_matters(release, "lease", cohort))] == ["002"]
    assert [r["corp"] for r in rows(c.search_audit_procedures(release, "lease"))] == ["002"]
    life = by(c.get_kam_lifecycle(release, "001", 2023), "topic", "fy")
    assert life["revenue", 2023]["entry"] == "returned" and life["revenue", 2021]["exit"] == "dropped"


def test_notes(release):
    got = by(c.get_accounting_policy(release, "001", 2023, ["leases", "policy"]), "topic")
    assert got["leases"]["receipt"] == "r0012023" and got["leases"]["locator"]["section"] == "n1" and got["policy"]["state"] == "unavailable"
    cohort = c.select_peer_group(release, "001", prefix="26")
    peers = by(c.compare_peer_accounting_policies(release, cohort, 2023, "leases"), "peer")
    assert peers["002"]["similarity"] == 0.2 and peers["003"]["excerpt"] is None and peers["003"]["state"] == "unverified" and peers["005"]["state"] == "unavailable"
    notes = by(c.compare_peer_accounting_notes(release, cohort, 2023, ["leases"], ["debt"]), "corp")
    assert notes["002"]["debt"] == 122 and notes["001"]["excerpt"] and notes["003"]["excerpt"] is None
    change = rows(c.get_accounting_policy_changes(release, "001", "leases", 2022, 2023))[0]
    assert change["added"] == ["New rule!"] and change["removed"] == ["Old rule."] and change["state"] == "available"


def test_context(release):
    got = by(c.get_semantic_company_context(release), "corp", "fy")
    assert got["001", 2023]["state"] == "available" and got["001", 2023]["section_topics"] == ["kam", "opinion"] and got["002", 2022]["state"] == "summary_only"
    cohort = c.select_peer_group(release, "001", prefix="26")
    review = by(c.semantic_peer_context_review(release, cohort, 2023), "peer")
    assert review["002"]["shared"] == ["kam", "opinion"] or set(review["002"]["shared"]) == {"kam", "opinion"}
    assert review["005"]["state"] == "summary_only"


def test_written_release_reads_back(release, spark, tmp_path):
    release.write(f"{tmp_path}/release")
    again = Release.at(spark, f"{tmp_path}/release")
    assert rows(c.search_company(again, "가람"))[0]["corp"] == "001"
    assert by(again.coverage(), "fy")[2023]["ratio"] == 0.6


def test_an_empty_release_knows_nothing(spark):
    empty = Release(spark, {})
    assert rows(c.get_accounting_policy(empty, "001", 2023, ["leases"])) == []
    assert rows(c.search_dataset(empty, "x")) == []


def test_results_say_where_they_come_from(release):
    assert {r["state"] for r in rows(c.get_audit_history(release, "001"))} == {"summary_only"} and by(c.get_audit_history(release, "001"), "fy")[2023]["receipt"] == "r0012023"
    life = rows(c.get_kam_lifecycle(release, "001", 2023))
    assert life and all(r["receipt"] and r["state"] == "summary_only" for r in life)
    got = rows(c.compare_to_industry(release, "002", "revenue", 2023))[0]
    assert (got["rule"], got["n_cohort"]) == ("industry:2 digits:26", 3)
    assert all(r["rule"] == "prefix:26" and r["state"] == "summary_only" for r in rows(c.get_industry_audit_landscape(release, "26", 2023)))
    missing = rows(c.get_audit_report_sections(release, "004", 2023, "opinion"))
    assert [(r["corp"], r["topic"], r["text"], r["state"]) for r in missing] == [("004", "opinion", None, "unavailable")]
    concern = by(c.score_going_concern(release, "001", [2023, 2024]), "fy")
    assert concern[2023]["provenance"]["receipt"] == "r0012023" and len(concern[2024]["next_checks"]) == 6 and concern[2023]["facts"]["modified_opinion"]
    pack = by(c.get_quality_of_earnings_pack(release, "001", [2023]), "fy")[2023]
    assert pack["facts"]["net_income"] == 12 and pack["provenance"]["topic"] == "quality of earnings"


def test_features(release):
    got = {(r["table"], r["fy"]): r["n_sourced"] for r in rows(release.features())}
    assert got["filing", 2023] == 3 and got["kam", 2021] == 1 and ("company", None) not in got
