"""Cells of planted workbooks: strings, numbers, dates, merged ranges, bounds, and files that can't be read."""

import zipfile

from tallyspark.sources import workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def plant(path, sheets, active=0):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>품목</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="&quot;₩&quot;#,##0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="3"/></cellXfs></styleSheet>')
        for i, (_, body) in enumerate(sheets):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}>{body}</worksheet>")


def cell(at, value, more=""):
    return f'<c r="{at}" {more}><v>{value}</v></c>'


def test_cells(spark, tmp_path):
    first = "<sheetData><row>" + cell("B2", 0, 't="s"') + cell("C2", 1, 't="s"') + cell("D2", 7) + "</row><row>" + cell("B3", 45356, 's="1"') + cell("C3", "1234567.6", 's="2"') + cell("D3", 1, 't="b"') + '<c r="E3" t="inlineStr"><is><t>in</t></is></c><c r="F3" s="1"/>' + cell("G3", "2.50") + "</row>"
    first += "<row>" + cell("B81", 1) + cell("B82", 2) + cell("AE81", 3) + cell("AF81", 4) + "</row></sheetData>"
    first += '<mergeCells><mergeCell ref="C2:D4"/><mergeCell ref="B50:C50"/></mergeCells>'
    plant(tmp_path / "a.xlsx", [("first", first), ("empty", "<sheetData/>"), ("last", "<sheetData><row>" + cell("A1", 5000, 's="3"') + "</row></sheetData>")], active=2)
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    plant(tmp_path / "large.xlsm", [("s", "<sheetData><row>" + cell("A1", 1) + "</row></sheetData>" + "<!--" + "x" * 9000 + "-->")])
    (tmp_path / "text.csv").write_text("a,b")
    rows = workbooks.workbook_cells(spark, str(tmp_path), most_bytes=8000).collect()
    got = {(r.sheet, r.row, r.col): (r.value, r.rowspan, r.colspan, r.active) for r in rows if not r.error}
    assert got == {
        ("first", 2, 2): ("품목", 1, 1, False), ("first", 2, 3): ("two runs", 3, 2, False),
        ("first", 3, 2): ("2024-03-05 00:00:00", 1, 1, False), ("first", 3, 5): ("in", 1, 1, False), ("first", 3, 7): ("2.5", 1, 1, False),
        ("first", 50, 2): (None, 1, 2, False), ("first", 81, 2): ("1", 1, 1, False), ("first", 81, 31): ("3", 1, 1, False),
        ("last", 1, 1): ("5,000", 1, 1, True),
    }
    assert sorted((r.path.rsplit("/", 1)[1], r.error[:10]) for r in rows if r.error) == [("bad.xlsx", "BadZipFile"), ("large.xlsm", "too large")]


def test_places_and_numbers():
    assert workbooks.place("AA10") == (10, 27)
    assert [workbooks.shown(x, k) for x, k in (("3.0", "plain"), ("0.1", "plain"), ("1234567.6", "grouped"), ("1.5", "date"))] == ["3", "0.1", "1,234,568", "1899-12-31 12:00:00"]
