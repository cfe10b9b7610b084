"""The evidence contract."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from attestra.functions import evidence as ev
from attestra.functions.bounds import bounded_keys, bounded_limit, search_term
from attestra.operators import audit, disclosure, financial, notes, peers, semantic


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_combining_never_upgrades(spark):
    pairs = list(itertools.product([*ev.STATES, None, "unknown"], repeat=2))
    df = spark.createDataFrame(pairs, "a string, b string")
    for a, b, both, worse in df.select("a", "b", ev.combined(F.col("a"), F.col("b")), ev.derived(F.col("a"))).collect():
        rank = lambda s: ev.STATES.index(s) if s in ev.STATES else 3
        assert rank(both) == max(rank(a), rank(b))
        assert rank(worse) == max(rank(a), 1)


def test_grid_has_a_row_for_every_request(spark):
    companies = spark.createDataFrame([("001",), ("002",)], "corp string")
    assert ev.grid(companies, [2020, 2021, 2022], ["leases", "policy"]).count() == 12


def test_only_available_excerpts_show(spark):
    df = spark.createDataFrame([(s, "원문") for s in ev.STATES], "state string, excerpt string")
    got = {r.state: r.x for r in df.select("state", ev.shown(F.col("excerpt"), F.col("state")).alias("x")).collect()}
    assert got == {"available": "원문", "summary_only": None, "unverified": None, "unavailable": None}


def test_answer_keeps_its_parts_apart(spark):
    df = spark.createDataFrame([("001", 2020, "r1", "leases", "available", 5.0)], "corp string, fy int, receipt string, topic string, state string, v double")
    provenance = {c: F.col(c) for c in ev.PROVENANCE}
    row = df.select(*ev.answer({"v": F.col("v")}, {"high": F.col("v") > 3}, [F.lit("look"), F.lit(None).cast("string")], provenance)).first()
    assert row.facts.v == 5.0 and row.analysis.high and row.next_checks == ["look"] and row.provenance.receipt == "r1"
    with pytest.raises(ValueError):
        ev.answer({}, {}, [], {"corp": F.col("corp")})


def test_bounds():
    for wrong in (0, 1001):
        with pytest.raises(ValueError):
            bounded_limit(wrong)
    with pytest.raises(ValueError):
        bounded_keys([])
    with pytest.raises(ValueError):
        search_term("")


def test_cohorts_do_not_depend_on_row_order(spark):
    data = [(i, "a" if i % 3 else "b", float(i * 37 % 11)) for i in range(40)]
    one, two = (spark.createDataFrame(d, "corp long, industry string, size double") for d in (data, data[::-1]))
    assert rows(peers.peers_by_size(one, 3)) == rows(peers.peers_by_size(two, 3))


def test_lone_company_has_no_peers(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "corp long, industry string, size double")
    assert peers.peers_by_size(df).count() == 0


def test_restatement_gap_changes_sign(spark):
    a, b = (spark.createDataFrame([("k", v), ("z", z)], "key string, value double") for v, z in ((100.0, 0.0), (103.0, None)))
    forth = {r.key: r for r in audit.detect_restatement(a, b).collect()}
    back = {r.key: r for r in audit.detect_restatement(b, a).collect()}
    assert forth["k"].candidate and back["k"].candidate and forth["k"].gap > 0 > back["k"].gap
    assert forth["z"].state == "unavailable" and forth["z"].gap is None
    assert back["z"].candidate is None


def test_missing_factors_are_not_passed(spark):
    df = spark.createDataFrame([("a", 2020, True, None, False, None, None, None), ("b", 2020, *[None] * 6)], "corp string, fy int, " + ", ".join(f"{f} boolean" for f in audit.FACTORS))
    assert rows(audit.score_going_concern(df)) == [("a", 2020, 1, 2, 4, "unverified"), ("b", 2020, 0, 0, 6, "unavailable")]


def test_kam_returns_and_drops(spark):
    df = spark.createDataFrame([("a", "t", y) for y in (2018, 2019, 2021, 2022)], "corp string, topic string, fy int")
    assert rows(audit.kam_lifecycle(df, 2022)) == [("a", "t", 2018, "new", "kept"), ("a", "t", 2019, "continued", "dropped"), ("a", "t", 2021, "returned", "kept"), ("a", "t", 2022, "continued", "open")]


def test_auditor_tenure_restarts(spark):
    df = spark.createDataFrame([("a", y, n) for y, n in ((2018, 1), (2019, 1), (2020, 2), (2022, 2), (2023, 1))], "corp string, fy int, auditor int")
    assert [r.tenure for r in audit.audit_history(df).orderBy("fy").collect()] == [1, 2, 1, 2, 1]


def test_missing_subsidiary_is_a_row(spark):
    perimeter = spark.createDataFrame([("p", "a", 2020), ("p", "b", 2020)], "parent string, corp string, fy int")
    leads = spark.createDataFrame([("a", 2020, 3)], "corp string, fy int, auditor int")
    found = audit.subsidiary_auditors(perimeter, leads)
    assert {r.corp: r.state for r in found.collect()} == {"a": "available", "b": "unavailable"}
    assert audit.auditor_matrix(found, [3]).first().missing == 1


def test_facts_from_changing_tables(spark):
    old = spark.createDataFrame([("a", 2019, 5.0, None)], "corp string, fy int, Revenue double, Debt double")
    new = spark.createDataFrame([("a", 2020, 6.0)], "corp string, fy int, `Revenue, net` double")
    aliases = {"Revenue": "revenue", "Revenue, net": "revenue", "Debt": "debt"}
    both = financial.normalized_facts(old, aliases).unionByName(financial.normalized_facts(new, aliases))
    assert rows(both) == [("a", 2019, "revenue", 5.0), ("a", 2020, "revenue", 6.0)]
    assert financial.financial_snapshot(both, ["revenue", "debt"]).where("fy = 2020").first().asDict() == {"corp": "a", "fy": 2020, "revenue": 6.0, "debt": None}


def test_gap_year_has_no_growth(spark):
    df = spark.createDataFrame([("a", 2018, 10.0, 5.0), ("a", 2020, 10.0, 8.0), ("a", 2021, 0.0, 4.0)], "corp string, fy int, gross double, net double")
    got = {r.fy: r for r in financial.quality_of_earnings(df).collect()}
    assert got[2020].yoy is None and got[2021].yoy == -0.5 and got[2021].conversion is None


def test_as_of_takes_the_same_moment(spark):
    left = spark.createDataFrame([("u", 1, "x"), ("u", 5, "y"), ("v", 5, "z")], "k string, t int, name string")
    right = spark.createDataFrame([("u", 5, 50), ("u", 3, 30), ("u", 6, 60)], "k string, t int, id int")
    assert rows(disclosure.as_of(left, right, "k", "t", "t", "id").select("name", "latest_id")) == [("x", None), ("y", 50), ("z", None)]


def test_unknown_receipts_are_unverified(spark):
    filings = spark.createDataFrame([("r1", "a", "available")], "receipt string, corp string, state string")
    requests = spark.createDataFrame([("r1",), ("r2",)], "receipt string")
    assert rows(disclosure.disclosure_lookup(requests, filings)) == [("r1", "a", "available"), ("r2", None, "unverified")]


def test_policy_states_and_korean(spark):
    docs = spark.createDataFrame([(1, "제1조 리스 정책\n사용권자산"), (2, "없음"), (3, None)], "doc_id long, text string")
    checked = spark.createDataFrame([(2,), (2,)], "doc_id long")
    got = {r.doc_id: r for r in notes.accounting_policy(docs, ["리스"], checked).collect()}
    assert got[1].state == "available" and got[1].excerpt.startswith("리스 정책") and got[1]["at"] == 5
    assert got[2].state == "unverified" and got[2].excerpt is None
    assert got[3].state == "unavailable"


def test_context_states(spark):
    a = spark.createDataFrame([("a", 2020, 1)], "corp string, fy int, x int")
    b = spark.createDataFrame([("a", 2020, 2), ("b", 2020, 3)], "corp string, fy int, y int")
    assert rows(semantic.company_context(a, b)) == [("a", 2020, 1, 2, "available"), ("b", 2020, None, 3, "summary_only")]


def test_a_response_shows_what_is_missing(spark):
    import json

    from attestra.functions.evidence import response

    df = spark.sql("SELECT '001' AS corp, named_struct('receipt', CAST(NULL AS string), 'state', 'unavailable') AS provenance, array('a') AS next_checks, CAST(NULL AS double) AS value")
    assert json.loads(response(df).first().response) == {"corp": "001", "provenance": {"receipt": None, "state": "unavailable"}, "next_checks": ["a"], "value": None}


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from attestra.tables import shared_dir

    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))

    assert shared_dir(session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://x:7077"):
        with pytest.raises(ValueError):
            shared_dir(session(**{"spark.master": master}))
