"""The named operations that use the index, vectors, perimeters, threads and alignment, over a small invented release."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest

from attestra import catalog as c
from attestra.release import SCHEMAS, Release

T = datetime.datetime


def tables(spark) -> dict:
    sections = [
        ("r1", "001", 2023, "audit", "kam", "Revenue recognition of long contracts. We tested cut-off.", 0, 60, "available"),
        ("r1", "001", 2023, "audit", "opinion", "Unqualified opinion on the statements", 61, 99, "available"),
        ("r2", "002", 2023, "audit", "kam", "Recognition of revenue from long contracts", 0, 44, "available"),
        ("r3", "003", 2023, "audit", "kam", "Goodwill impairment and discount rates", 0, 40, "available"),
        ("r3", "003", 2023, "procedure", "kam", "We tested contracts and revenue cut-off, contracts again", 41, 99, "available"),
        ("r2", "002", 2023, "audit", "secret", "revenue revenue revenue contracts", 50, 90, "summary_only"),
        ("r4", "004", 2022, "audit", "kam", "Revenue of contracts", 0, 20, "available"),
    ]
    rows = {
        "company": [("001", "Samsung Electronics", "2611"), ("002", "Alpha Chips", "2612"), ("003", "Alphabet Soup", "2620"), ("004", "Beta", "4711")],
        "filing": [("r1", "001", 2022, "annual", T(2023, 3, 31)), ("r1b", "001", 2023, "annual", T(2024, 3, 31))],
        "fact": [("001", 2022, 2022, "revenue", Decimal(100), "r1"), ("001", 2022, 2023, "revenue", Decimal(130), "r1b")],
        "section": sections,
        "note": [("n1", "001", 2022, "leases", "Same rule. Kept too. Old rule. Gone away.", ("n", 100, 141), {}, "available"), ("n2", "001", 2023, "leases", "Gone away. Same rule. Kept too. New rule.", ("n", 7, 48), {}, "available"), ("n3", "002", 2023, "leases", "x", None, {}, "unverified")],
        "subsidiary": [("001", "002", 2023), ("002", "003", 2023), ("003", "004", 2023), ("004", "001", 2023), ("001", "004", 2022)],
        "kam": [("001", 2022, "revenue recognition", "r1"), ("001", 2023, "revenue recognition cut-off", "r1b")],
    }
    return {n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()}


@pytest.fixture(scope="module", params=["built", "written"])
def release(spark, request, tmp_path_factory) -> Release:
    own = Release(spark, tables(spark))
    if request.param == "built":
        return own
    path = str(tmp_path_factory.mktemp("release") / "r1")
    own.write(path)
    return Release.at(spark, path)


def cohort(release):
    return c.select_peer_group(release, "001", members=["002", "003", "004"])


def test_misspelt_company(release):
    assert [r["corp"] for r in c.search_company(release, "samsong electronics").collect()] == ["001"]
    assert c.search_company(release, "samsong electronics", typos=0).collect() == [] and c.search_company(release, "xyz").collect() == []


def test_ranked_matters(release):
    got = c.search_audit_report_matters(release, "revenue contracts", ranked=True).collect()
    assert [(r.corp, r.topic) for r in got] == [("004", "kam"), ("002", "kam"), ("001", "kam")]
    assert all("ontracts" in r.text and r.state == "available" for r in got)
    assert [r.corp for r in c.search_audit_report_matters(release, "revenue contracts", cohort(release), 1, ranked=True).collect()] == ["004"]
    assert [r.start for r in c.search_audit_procedures(release, "Revenue", ranked=True).collect()] == [41]


def test_review_by_text(release):
    got = c.semantic_peer_context_review(release, cohort(release), 2023, nearest=2).orderBy("target_topic", "rank").collect()
    best = {r.peer_receipt: r for r in got if r.target_topic == "kam"}
    assert best.keys() == {"r2", "r3"} and {r["rank"] for r in best.values()} == {1, 2}
    assert all(r.state == "summary_only" and r.score > 0.2 and r.rule == "explicit" for r in best.values())
    assert all(r.target == "001" and r.peer != "001" for r in got)


def test_whole_perimeter(release):
    of = lambda depth: {(r.parent, r.corp, r.state) for r in c.get_subsidiary_auditors(release, "001", 2023, depth).collect()}
    assert of(None) == {(p, x, "unavailable") for p, x in (("001", "002"), ("002", "003"), ("003", "004"), ("004", "001"))}
    assert {x[:2] for x in of(2)} == {("001", "002"), ("002", "003")} and {x[:2] for x in of(1)} == {("001", "002")}


def test_restatement_as_it_was_known(release):
    now = c.detect_restatement(release, "001", 2022).first()
    assert now.candidate and now.later_receipt == "r1b"
    then = c.detect_restatement(release, "001", 2022, known_at="2023-12-31").first()
    assert then.original == 100 and then.re_reported is None and then.state == "unavailable"
    assert c.detect_restatement(release, "001", 2022, known_at="2023-01-01").collect() == []


def test_reworded_matter(release):
    got = {r.fy: (r.entry, r.exit, r.prior) for r in c.get_kam_lifecycle(release, "001", 2023, reworded=0.5).collect()}
    assert got == {2022: ("new", "kept", None), 2023: ("reworded", "open", "revenue recognition")}
    assert {r.entry for r in c.get_kam_lifecycle(release, "001", 2023).collect()} == {"new"}


def test_policy_spans(release):
    got = [(r.kind, r.before_start, r.before_end, r.after_start, r.after_end) for r in c.get_accounting_policy_spans(release, "001", "leases", 2022, 2023).orderBy("nth").collect()]
    assert got == [("moved", 131, 141, 7, 17), ("changed", 121, 130, 39, 48)]
    assert c.get_accounting_policy_spans(release, "002", "leases", 2022, 2023).collect() == []
