"""All 29 tools answer in four parts, with provenance."""

from __future__ import annotations

import pytest

from attestra import catalog as c
from attestra.functions.evidence import PROVENANCE, STATES
from attestra.release import Release

from .test_catalog_ranked import tables

PARTS = ["facts", "analysis", "next_checks", "provenance"]


@pytest.fixture(scope="module")
def release(spark) -> Release:
    return Release(spark, tables(spark))


def calls(r: Release) -> dict:
    cohort = c.select_peer_group(r, "001", members=["002", "003", "004"])
    return {
        "search_company": lambda: c.search_company(r, "alpha"),
        "search_dataset": lambda: c.search_dataset(r, "revenue"),
        "select_peer_group": lambda: cohort,
        "get_financial_snapshot": lambda: c.get_financial_snapshot(r, "001", 2022, ["revenue", "assets"]),
        "compare_to_industry": lambda: c.compare_to_industry(r, "001", "revenue", 2022),
        "compare_to_industry_multi": lambda: c.compare_to_industry_multi(r, "001", ["revenue"], 2022),
        "get_quality_of_earnings_pack": lambda: c.get_quality_of_earnings_pack(r, "001", [2022]),
        "get_dcf_input_candidates": lambda: c.get_dcf_input_candidates(r, "001", 2022),
        "get_investor_signals": lambda: c.get_investor_signals(r, "001", [2022]),
        "search_disclosure_events": lambda: c.search_disclosure_events(r, ["merger"], "2020-01-01", "2024-01-01"),
        "fetch_disclosure_on_demand": lambda: c.fetch_disclosure_on_demand(r, ["r1", "nowhere"]),
        "score_going_concern": lambda: c.score_going_concern(r, "001", [2022]),
        "detect_restatement": lambda: c.detect_restatement(r, "001", 2022),
        "build_audit_acceptance_pack": lambda: c.build_audit_acceptance_pack(r, "001", [2022]),
        "estimate_audit_hours_proxy": lambda: c.estimate_audit_hours_proxy(r, "001", 2022),
        "get_audit_history": lambda: c.get_audit_history(r, "001"),
        "get_subsidiary_auditors": lambda: c.get_subsidiary_auditors(r, "001", 2023),
        "get_industry_audit_landscape": lambda: c.get_industry_audit_landscape(r, "26", 2023),
        "compare_peer_audit_fees": lambda: c.compare_peer_audit_fees(r, cohort, 2023),
        "get_audit_report_sections": lambda: c.get_audit_report_sections(r, "001", 2023),
        "search_audit_report_matters": lambda: c.search_audit_report_matters(r, "revenue"),
        "search_audit_procedures": lambda: c.search_audit_procedures(r, "tested"),
        "get_kam_lifecycle": lambda: c.get_kam_lifecycle(r, "001", 2023),
        "get_accounting_policy": lambda: c.get_accounting_policy(r, "001", 2023, ["leases", "other"]),
        "compare_peer_accounting_policies": lambda: c.compare_peer_accounting_policies(r, cohort, 2023, "leases"),
        "compare_peer_accounting_notes": lambda: c.compare_peer_accounting_notes(r, cohort, 2023, ["leases"], ["revenue"]),
        "get_accounting_policy_changes": lambda: c.get_accounting_policy_changes(r, "001", "leases", 2022, 2023),
        "get_semantic_company_context": lambda: c.get_semantic_company_context(r),
        "semantic_peer_context_review": lambda: c.semantic_peer_context_review(r, cohort, 2023),
    }


def test_every_tool_parts_its_answer(release):
    every = calls(release)
    assert every.keys() == c.TOOLS.keys()
    for name, call in every.items():
        found = call()
        answer = c.answered(name, found)
        assert answer.columns == PARTS, name
        part = {p: set(answer.select(f"{p}.*").columns) if answer.schema[p].dataType.simpleString() != "struct<>" else set() for p in ("facts", "analysis", "provenance")}
        assert set(PROVENANCE) <= part["provenance"], name
        if not set(PARTS) <= set(found.columns):  # each column is in one part
            told = set(found.columns) - {x for names in c.ABOUT.values() for x in names}
            assert told <= part["facts"] | part["analysis"] | part["provenance"] and not part["facts"] & part["analysis"], name


def test_states_and_checks(release):
    rows = {r.provenance.topic: r for r in c.answered("get_accounting_policy", calls(release)["get_accounting_policy"]()).collect()}
    assert rows["leases"].facts.excerpt.startswith("Gone away") and rows["leases"].provenance.receipt == "n2" and rows["leases"].next_checks == []
    assert rows["other"].facts.excerpt is None and rows["other"].provenance.state == "unavailable" and rows["other"].next_checks == ["look for a missing filing"]
    found = {r.provenance.receipt: r for r in c.answered("fetch_disclosure_on_demand", calls(release)["fetch_disclosure_on_demand"]()).collect()}
    assert found["nowhere"].next_checks == ["check the source"] and {r.provenance.state for r in found.values()} <= set(STATES)
    with pytest.raises(ValueError, match="no tool"):
        c.answered("other", c.search_company(release, "alpha"))
