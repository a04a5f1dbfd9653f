import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import export as O
from gaugeline.operators import extract as X
from gaugeline.sources import readers as S
from gaugeline.streaming import ingest

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
BOOK = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" r:id="r1"/><sheet name="b" r:id="r2"/></sheets></workbook>'
LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>'
STYLES = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
SHARED = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Narrative</t></si><si><t>Inspected</t></si><si><t>Valve cracked.</t></si></sst>'
WORD = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Inspection start.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Valve</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>cracked</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Repair required.</w:t></w:r></w:p></w:body></w:document>'


def workbook(path):
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2" s="1"><v>46304</v></c></row><row><c r="C3" s="1"><v>46305</v></c></row>'
    with zipfile.ZipFile(path, "w") as z:
        for name, text in (("xl/workbook.xml", BOOK), ("xl/_rels/workbook.xml.rels", LINKS), ("xl/styles.xml", STYLES), ("xl/sharedStrings.xml", SHARED), ("xl/worksheets/sheet1.xml", SHEET.format("")), ("xl/worksheets/sheet2.xml", SHEET.format(rows))):
            z.writestr(name, text)


def test_files_become_segments_and_errors_stay_apart(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", WORD)
    (tmp_path / "c.txt").write_text("plain text")
    (tmp_path / "d.xlsx").write_bytes(b"no zip")
    (tmp_path / "e.exe").write_bytes(b"x")
    got = {}
    for r in S.segments(S.files(spark, str(tmp_path))).collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append(r)
    assert [r["cells"] for r in got["a.xlsx"]] == [{"Narrative": "Valve cracked.", "Inspected": "2026-10-09"}, {"Narrative": "", "Inspected": "2026-10-10"}]
    assert got["b.docx"][0]["cells"]["text"] == "Inspection start.\nValve | cracked\nRepair required."
    assert got["c.txt"][0]["cells"]["text"] == "plain text"
    assert got["d.xlsx"][0]["error"] and "not supported" in got["e.exe"][0]["error"]
    assert S.checksums(spark, str(tmp_path)).count() == 5


def test_tables_with_mapped_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Notes,Supplier,When,Code,Target\n"Valve cracked, badly at seam","ACME  Ltd",9/1/2026,R-1,secret\n  ,B,1/1/2026,R-2,x\n')
    table = S.delimited(spark, str(tmp_path / "a.csv"))
    assert S.headers(spark, str(tmp_path / "a.csv")) == ["Notes", "Supplier", "When", "Code", "Target"]
    row = S.records(table, "Notes", {"vendor": "Supplier", "report_date": "When", "report_number": "Code"}, {"batch": "B7", "vendor": "other"}, "d/M/yyyy", {"acme ltd": "Acme"}).collect()
    assert len(row) == 1 and row[0]["report_date"] == "2026-01-09" and row[0]["vendor_key"] == "acme" and row[0]["vendor"] == "ACME Ltd" and row[0]["batch"] == "B7"
    assert row[0]["quality_flags"] == ["empty_rows:1"] and "secret" not in str(row) and row[0]["provenance"]["vendor"] == "column:Supplier"
    with pytest.raises(ValueError):
        S.records(table, "Missing")
    with pytest.raises(ValueError):
        S.records(table, "Notes", {"nonsense": "Code"})
    with pytest.raises(Exception, match="ambiguous"):
        S.records(table, "Notes", {"report_date": "When"}, date_format="yyyy-M-d").collect()


def test_ragged_and_broken_lines_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception):
        S.delimited(spark, str(tmp_path / "a.csv")).collect()
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a":\n')
    with pytest.raises(Exception):
        S.json_lines(spark, str(tmp_path / "a.json"), "a long").collect()


def test_a_broken_table_stops_no_other_file(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "x,y\n1,2,3\n"), ("c.csv", "x,x\n1,2\n"), ("d.tsv", "x\ty\n1\t2\n3\t4\n"), ("e.csv", "\n1,2\n")):
        (tmp_path / name).write_text(text)
    found = S.files(spark, str(tmp_path))
    by = {}
    for r in S.segments(found).collect():
        by.setdefault(r["path"].rpartition("/")[2], []).append((r["cells"], r["error"]))
    assert by["a.csv"] == [({"x": "1", "y": "2"}, None)] and len(by["d.tsv"]) == 2
    assert "line 2" in by["b.csv"][0][1] and "more than once" in by["c.csv"][0][1] and "no header" in by["e.csv"][0][1]
    times = {r["path"].rpartition("/")[2]: r for r in S.benchmark(found, found.select("path")).collect()}
    assert times["d.tsv"]["segments"] == 2 and times["b.csv"]["error"] and times["a.csv"]["seconds"] >= 0
    with pytest.raises(ValueError):
        S.benchmark(found, found.select("path").limit(1))


def test_dialects(spark):
    rows = spark.createDataFrame([("Leak at pipe", "7", "x", " "), ("", "8", None, "y")], "NARRATIVE string, REPORT_NUMBER string, CAUSE string, CAUSE_DETAILS string")
    got = S.source_records(rows, S.dialect_of("/d/incidents_2010.txt"), "/d/incidents_2010.txt").orderBy("source_record_id").collect()
    assert [r["excluded"] for r in got] == ["", "empty_narrative"] and got[0]["structured"] == {"CAUSE": "x"}
    assert S.dialect_of("a/b_mar2004_dec2009.txt") == "phmsa_legacy"
    with pytest.raises(ValueError):
        S.source_records(rows, "faa_sdr", "x.csv")


def found(spark):
    rows = spark.createDataFrame([("r1", "Valve <cracked>.", "pipeline", "=EVIL()", "1"), ("r2", "Nothing.", "pipeline", "B", "2")], "record_id string, narrative string, domain string, vendor string, report_id string")
    rows = rows.withColumns({"report_date": F.lit("2024-01-01"), "batch": F.lit("b"), "asset_id": F.lit("@A"), "report_status": F.lit(None).cast("string")})
    return X.findings(X.extract(rows))


def test_exports(spark, tmp_path):
    from gaugeline.operators import analytics as A

    rows = found(spark)
    O.write_csv(rows, str(tmp_path / "csv"))
    lines = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert len(lines) == 3 and {r["vendor"] for r in lines} == {"'=EVIL()", "B"} and {r["asset_id"] for r in lines} == {"'@A"}
    with pytest.raises(Exception):
        O.write_csv(rows, str(tmp_path / "csv"))
    assert len(lines[0].asDict()) == 31
    O.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    O.write_json(rows, str(tmp_path / "list.json"), "list")
    O.write_json(rows, str(tmp_path / "envelope.json"), "envelope")
    one, two = (json.loads((tmp_path / f"{n}.json").read_text()) for n in ("list", "envelope"))
    assert [r["record_id"] for r in one] == ["r1", "r2"] and two["export_schema_version"] == "1" and two["records"] == one
    with pytest.raises(Exception):
        O.write_json(rows, str(tmp_path / "list.json"), "list")
    found_rows = A.finding_rows(rows)
    O.write_html(rows, A.overview(rows, found_rows), A.vendor_rates(rows, found_rows), str(tmp_path / "page.html"))
    page = (tmp_path / "page.html").read_text()
    assert "&lt;<mark title=\"DEFECT · present\">cracked</mark>&gt;" in page and "<cracked>" not in page
    assert page.count("<section>") == 2 and page.index("<h2>r1") < page.index("<h2>r2") and "=EVIL()" in page


def test_arriving_files_are_stored_once(spark, tmp_path):
    source, schema = tmp_path / "in", "record_id string, narrative string, domain string"
    source.mkdir()
    line = lambda i: json.dumps({"record_id": f"r{i}", "narrative": "Valve cracked.", "domain": "pipeline"})
    for k, ids in enumerate(([1, 2], [2, 3])):
        (source / f"{k}.json").write_text("\n".join(map(line, ids)))
        ingest.ingest(ingest.arriving(spark, str(source), schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["record_id"] for r in rows.collect()) == ["r1", "r2", "r3"]
    assert rows.where("size(findings) = 1").count() == 3
