"""Archives, releases and streams."""

from __future__ import annotations

import datetime
import zipfile
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException

from attestra.catalog import get_accounting_policy
from attestra.operators.search import search_company
from attestra.release import Release
from attestra.sources import archive, ingest
from attestra.streaming.events import appended, event_stream, sessions, windowed

XML = "<?xml version='1.0' encoding='{0}'?><DOC><SECTION><TITLE>리스 &amp; 정책</TITLE><P>사용권자산 &lt;1&gt;</P><P>리스부채</P></SECTION><SECTION><P>둘째</P></SECTION></DOC>"


@pytest.fixture
def folder(tmp_path):
    def write(name, **members):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for member, content in members.items():
                z.writestr(f"{member}.xml", content)

    write("good", report=XML.format("UTF-8").encode())
    write("legacy", report=XML.format("EUC-KR").encode("cp949"))
    write("odd", a=b"\xff\xfe\x80\x81", b=b"<DOC><SECTION>", c=b"<DOC/>")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    return tmp_path


def test_sections_of_archives(spark, folder):
    got = archive.report_sections(archive.archives(spark, str(folder))).collect()
    by = {(r.archive.rpartition("/")[2], r.member, r.section): r for r in got}
    for name in ("good.zip", "legacy.zip"):
        first = by[name, "report.xml", 0]
        assert (first.title, first.text, first.start, first.end, first.state) == ("리스 & 정책", "사용권자산 <1>\n리스부채", 0, 14, "available")
        assert by[name, "report.xml", 1].title is None and by[name, "report.xml", 1].start == 15
    errors = {k[:2]: r.error for k, r in by.items() if r.error}
    assert errors == {("odd.zip", "a.xml"): "undecodable", ("odd.zip", "b.xml"): "malformed XML", ("odd.zip", "c.xml"): "no section", ("broken.zip", ""): "corrupt archive"}
    assert all(r.state == "unverified" for r in got if r.error)


def test_release_is_immutable(spark, tmp_path):
    company = spark.createDataFrame([("00126380", "Alpha"), ("00164779", "Alphabeta")], "corp string, name string")
    manifest = archive.write_release({"company": company}, f"{tmp_path}/r1")
    assert manifest.first().n_rows == 2
    assert {r.corp for r in search_company(archive.read_release(spark, f"{tmp_path}/r1", "company"), "alpha").collect()} == {"00126380", "00164779"}
    with pytest.raises(AnalysisException):
        archive.write_release({"company": company}, f"{tmp_path}/r1")
    with pytest.raises(ValueError):
        archive.read_release(spark, f"{tmp_path}/r1", "filing")


def test_stream_agrees_with_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3, t0 + datetime.timedelta(minutes=7 * i), "a" if i % 2 else "b", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, corp long, ts timestamp, type string, value double")
    for part in range(3):
        df.where(f"event_id >= {20 * part} AND event_id < {20 * part + 20}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = event_stream(spark, f"{tmp_path}/in", df.schema, 10)
    appended(windowed(stream, "1 hour", lateness="10 minutes"), f"{tmp_path}/out", f"{tmp_path}/state").start().awaitTermination()
    got = {(r.type, r.begin, r.n, r.value) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.type, r.begin, r.n, r.value) for r in windowed(df, "1 hour").collect()}
    # windows that the watermark hasn't passed are still open
    assert got and got <= want and all(x[1] >= max(r[1] for r in got) for x in want - got)


def test_sessions_end_at_pauses(spark):
    t0 = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", t0 + datetime.timedelta(minutes=m)) for m in (0, 5, 40, 44)], "corp string, ts timestamp")
    assert sorted(r.n for r in sessions(df, "10 minutes").collect()) == [2, 2]


def test_archives_become_sections_and_notes(spark, folder):
    filings = spark.createDataFrame([("good", "001", 2023), ("legacy", "002", 2022)], "receipt string, corp string, fy int")
    found = archive.report_sections(archive.archives(spark, str(folder)))
    sections = {(r.receipt, r.start): r for r in ingest.release_sections(found, filings).collect() if r.start is not None}
    assert (sections["good", 0].corp, sections["good", 0].fy, sections["good", 0].kind, sections["good", 0].topic) == ("001", 2023, "other", "리스 & 정책")
    broken = [r for r in ingest.release_sections(found, filings).collect() if r.start is None]
    assert len(broken) == 4 and all(r.state == "unverified" and r.text is None for r in broken)
    notes = ingest.release_notes(found, filings).collect()
    assert {(r.receipt, r.topic, r.excerpt, r.locator.section, r.locator.start, r.locator.end) for r in notes} == {(x, "leases", "리스부채", "report.xml#0", 10, 14) for x in ("good", "legacy")}
    tables = Release(spark, {"company": spark.createDataFrame([("001", "가람", "2611")], "corp string, name string, code string"), "note": ingest.release_notes(found, filings)})
    got = {r.topic: r for r in get_accounting_policy(tables, "001", 2023, ["leases", "commitments"]).collect()}
    assert got["leases"].excerpt == "리스부채" and got["commitments"].state == "unavailable"


def test_json_lines_become_facts_and_disclosures(spark, tmp_path):
    lines = ['{"corp_code": "00126380", "bsns_year": "2022", "account_nm": "매출액", "thstrm_amount": "1,234.50", "rcept_no": "r1"}', '{"corp": "2", "fy": "2023", "reported_in": "2024", "account": "Revenue", "value": "-7", "receipt": "r2"}', '{"corp": "3", "fy": "x", "account": "Revenue", "value": "1"}', '{"corp": "3", "fy": "2023", "account": "other", "value": "1"}', "no json"]
    (tmp_path / "facts.json").write_text("\n".join(lines))
    got = {tuple(r) for r in ingest.facts_from_json(spark, str(tmp_path / "facts.json"), {"매출액": "revenue", "Revenue": "revenue"}).collect()}
    assert got == {("00126380", 2022, 2022, "revenue", Decimal("1234.50"), "r1"), ("2", 2023, 2024, "revenue", Decimal("-7.00"), "r2")}
    assert [r.value for r in ingest.rejected_lines(spark, str(tmp_path / "facts.json"), ["value"]).collect()] == [lines[0], "no json"]
    (tmp_path / "list.json").write_text('{"rcept_no": "e1", "corp_code": "1", "rcept_dt": "20230501", "report_nm": "merger"}\n{"event_id": "e2", "corp": "2", "ts": "2023-06-01 10:00:00", "type": "lawsuit"}\nbroken {')
    rows = {r.event_id: r for r in ingest.disclosures_from_json(spark, str(tmp_path / "list.json")).collect()}
    assert rows["e1"].ts == datetime.datetime(2023, 5, 1) and rows["e2"].type == "lawsuit" and len(rows) == 2 and "merger" in rows["e1"].attrs
