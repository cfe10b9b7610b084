"""Tables of reports: grids, header paths, units, numbers and what is none."""

from __future__ import annotations

import zipfile
from decimal import Decimal
from xml.etree import ElementTree

import pytest

from attestra.sources.archive import archives
from attestra.sources.report_tables import laid_out, table_cells, table_facts, tables_of

REPORT = """<?xml version="1.0" encoding="utf-8"?><DOC><SECTION><TITLE>재무제표</TITLE>
<P>요약 재무정보 (단위: 백만원)</P>
<TABLE><THEAD><TR><TD rowspan="2">과목</TD><TD colspan="2">당기</TD></TR><TR><TD>2023</TD><TD>2022</TD></TR></THEAD>
<TBODY><TR><TD>매출액</TD><TD>1,234</TD><TD>(56)</TD></TR><TR><TD>영업이익</TD><TD>△7.5</TD><TD> - </TD></TR>
<TR><TD>합계</TD><TD colspan="2">9</TD></TR></TBODY></TABLE>
<P>no unit here</P>
<TABLE><TR><TH/><TH>2023</TH></TR><TR><TH rowspan="2">Assets</TH><TD>100</TD></TR><TR><TD>200</TD></TR><TR><TD>note</TD><TD>see above</TD></TR></TABLE>
<TABLE><CAPTION>Lots (Unit: lots)</CAPTION><TR><TH>a</TH><TH>b</TH></TR><TR><TD>x</TD><TD>5</TD></TR></TABLE></SECTION></DOC>"""


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("reports")
    for name, text in (("r1", REPORT), ("r2", "<DOC><TABLE>"), ("r3", "<DOC><P>no table</P></DOC>")):
        with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
            z.writestr("report.xml", text)
    (folder / "r4.zip").write_bytes(b"no zip")
    return table_facts(table_cells(archives(spark, str(folder)))).collect()


def test_facts_have_their_headers_and_places(facts):
    got = {(r.nth, r.row, r.col): (r.account, r.period, r.value) for r in facts if r.state == "available"}
    assert got == {
        (0, 2, 1): ("매출액", "당기 / 2023", Decimal("1234000000.00")),
        (0, 2, 2): ("매출액", "당기 / 2022", Decimal("-56000000.00")),
        (0, 3, 1): ("영업이익", "당기 / 2023", Decimal("-7500000.00")),
        (0, 4, 1): ("합계", "당기 / 2023", Decimal("9000000.00")),
        (1, 1, 1): ("Assets", "2023", Decimal("100.00")),
        (1, 2, 1): ("Assets", "2023", Decimal("200.00")),
    }
    assert all(r.archive.endswith("r1.zip") and r.member == "report.xml" for r in facts if r.state == "available")


def test_nothing_vanishes(facts):
    left = {(r.archive.rpartition("/")[2], r.text, r.reason) for r in facts if r.state == "unverified"}
    assert left == {("r1.zip", "-", "no number"), ("r1.zip", "see above", "no number"), ("r1.zip", "5", "unknown unit"), ("r2.zip", None, "malformed XML"), ("r4.zip", None, "corrupt archive")}
    assert all(r.value is None for r in facts if r.state == "unverified")


def test_spans_fill_the_grid():
    table = ElementTree.fromstring('<TABLE><TR><TD rowspan="2" colspan="2">a</TD><TD>b</TD></TR><TR><TD>c</TD></TR><TR><TD>d</TD><TD rowspan="x">e</TD><TD rowspan="9">f</TD></TR></TABLE>')
    grid = {(r, c): t for r, c, *_, t in laid_out(table)}
    assert [[grid.get((r, c)) for c in range(3)] for r in range(3)] == [["a", "a", "b"], ["a", "a", "c"], ["d", "e", "f"]]
    assert sum(first for *_, first, _ in laid_out(table)) == 6
    assert [u for _, u in tables_of(REPORT)] == ["백만원", None, "lots"]


def test_no_archives(spark, tmp_path):
    assert table_facts(table_cells(spark.createDataFrame([], "archive string, content binary"))).collect() == []


def test_tables_become_facts_of_a_release(spark, tmp_path):
    from attestra.catalog import get_financial_snapshot
    from attestra.release import Release
    from attestra.sources.ingest import facts_from_tables
    from attestra.tables import materialize

    with zipfile.ZipFile(tmp_path / "r1.zip", "w") as z:
        z.writestr("report.xml", REPORT)
    with zipfile.ZipFile(tmp_path / "stray.zip", "w") as z:
        z.writestr("report.xml", "<DOC><TABLE><TR><TH/><TH>2023</TH></TR><TR><TH>Assets</TH><TD>1</TD></TR></TABLE></DOC>")
    filings = spark.createDataFrame([("r1", "001", 2023)], "receipt string, corp string, fy int")
    cells = materialize(table_facts(table_cells(archives(spark, str(tmp_path)))), "cells")
    facts, rejected = facts_from_tables(cells, filings, {"매출액": "revenue", "영업이익": "operating_income", "Assets": "assets"})
    got = {(r.corp, r.fy, r.reported_in, r.account, r.value, r.receipt) for r in facts.collect()}
    assert got == {("001", 2023, 2023, "revenue", Decimal("1234000000.00"), "r1"), ("001", 2022, 2023, "revenue", Decimal("-56000000.00"), "r1"), ("001", 2023, 2023, "operating_income", Decimal("-7500000.00"), "r1"), ("001", 2023, 2023, "assets", Decimal("100.00"), "r1")}
    left = {(r.archive.rpartition("/")[2], r.text, r.reason) for r in rejected.collect()}
    assert left == {("r1.zip", "9", "account isn't mapped"), ("r1.zip", "200", "repeated"), ("r1.zip", "-", "no number"), ("r1.zip", "see above", "no number"), ("r1.zip", "5", "unknown unit"), ("stray.zip", "1", "receipt isn't filed")}
    assert facts.count() + rejected.count() == cells.count()
    own = Release(spark, {"company": spark.createDataFrame([("001", "가람", "2611")], "corp string, name string, code string"), "fact": facts})
    assert {r.account: r.value for r in get_financial_snapshot(own, "001", 2022, ["revenue", "assets"]).collect()} == {"revenue": -56000000.0, "assets": None}


def test_rejected_lines_have_their_reason(spark, tmp_path):
    from attestra.sources.ingest import facts_from_json, rejected_facts

    lines = ['{"corp_code": "1", "bsns_year": "2022", "account_nm": "매출액", "thstrm_amount": "1,234.50", "rcept_no": "r1"}', '{"corp": "3", "fy": "x", "account": "Revenue", "value": "1"}', '{"corp": "3", "fy": "2023", "account": "other", "value": "1"}', '{"corp": "3", "fy": "2023", "account": "Revenue", "value": "n/a"}', '{"fy": "2023", "account": "Revenue", "value": "1"}', "no json", '{"corp": "4", "fy": "2023", "account": "Revenue"}']
    (tmp_path / "facts.json").write_text("\n".join(lines))
    path, accounts = str(tmp_path / "facts.json"), {"매출액": "revenue", "Revenue": "revenue"}
    assert [r.account for r in facts_from_json(spark, path, accounts).collect()] == ["revenue"]
    rows = rejected_facts(spark, path, accounts).collect()
    assert {(r.line, r.reason) for r in rows} == {(lines[1], "year is no number"), (lines[2], "account isn't mapped"), (lines[3], "value is no number"), (lines[4], "no company"), ("no json", "no JSON"), (lines[6], "no value")}
    assert all(r.state == "unverified" for r in rows)
