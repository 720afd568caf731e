"""Workbooks made here, read back: kinds of cells, sheets, rejects, dispatch."""

import io
import zipfile

import pytest
from lodestone.sources import files, sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(pages: dict[str, str], strings=(), date1904=False) -> bytes:
    """A workbook of sheets' row XML."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(pages, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(1, len(pages) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        for i, rows in enumerate(pages.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


KINDS = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row r="3"><c r="A3"><v>1.0</v></c><c r="B3"><v>2.5</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" t="e"><v>#N/A</v></c><c r="E3" t="str"><v>said</v></c><c r="AA3" s="1"><v>45000</v></c></row><row r="4"><c r="A4" s="2"><v>45000.5</v></c><c r="B4" s="3"><v>7</v></c><c r="C4" s="1"><v>59</v></c><c r="D4" s="1"><v>0.75</v></c></row><row r="9"><c r="A9" t="inlineStr"><is><t>  </t></is></c></row>'
STRINGS = ["<t>a</t>", "<r><t>b</t></r><r><t> c</t></r><rPh><t>x</t></rPh>"]


def test_kinds_of_cells():
    rows = list(sheets.workbook(book({"One": KINDS}, STRINGS)))
    assert rows == [
        ("One", 0, ["a", None, "in"]),
        ("One", 2, ["1", "2.5", "true", None, "said", *[None] * 21, "2023-03-15"]),
        ("One", 3, ["2023-03-15 12:00:00", "7", "1900-02-28", "18:00:00"]),
    ]
    assert list(sheets.workbook(book({"One": '<row><c t="s"><v>1</v></c><c s="1"><v>1</v></c></row>'}, STRINGS, date1904=True))) == [("One", 0, ["b c", "1904-01-02"])]


def number_rows(n):
    return '<row r="1"><c t="inlineStr"><is><t>k</t></is></c><c t="inlineStr"><is><t>v</t></is></c><c t="inlineStr"><is><t>k</t></is></c><c/></row>' + "".join(f"<row><c><v>{i}</v></c><c><v>{i * i}</v></c></row>" for i in range(n))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    (folder / "a.xlsx").write_bytes(book({"Big": number_rows(5000), "Empty": "", "Two &amp; three": number_rows(2)}))
    (folder / "b.xlsx").write_bytes(book({"Big": number_rows(3)}))
    (folder / "bad.xlsx").write_bytes(b"no zip")
    whole = book({"Big": number_rows(1)})
    (folder / "cut.xlsx").write_bytes(whole[: len(whole) // 2])
    return str(folder)


def test_sheets_of_files(spark, folder):
    rows, failed = sheets.spreadsheets(files.binary_files(spark, folder))
    assert {(r[0], r[1]) for r in rows.groupBy("source").count().collect()} == {("a.xlsx::Big", 5001), ("a.xlsx::Two & three", 3), ("b.xlsx::Big", 4)}
    assert {r.source for r in failed.collect()} == {"bad.xlsx", "cut.xlsx"} and all("BadZipFile" in r.error for r in failed.collect())
    one = sheets.table(rows, "a.xlsx::Big")
    assert one.columns == ["k", "v", "k.1", "Unnamed: 3"] and one.selectExpr("sum(cast(v as bigint))").first()[0] == sum(i * i for i in range(5000))
    assert sheets.spreadsheets(files.binary_files(spark, folder), "Two & three")[0].count() == 3
    shown = {r.source: r.markdown for r in sheets.markdown_tables(rows, 2).collect()}
    assert shown["b.xlsx::Big"].split("\n")[0].startswith("| k | v | k |") and len(shown["a.xlsx::Big"].split("\n")) == 4
    assert sheets.table(rows, "none").count() == 0


def test_choice_by_suffix(spark, folder, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x, ""y"""\n2,\n')
    assert [tuple(r) for r in sheets.cells(spark, str(tmp_path / "t.csv")).orderBy("ord").select("source", "cells").collect()] == [("t.csv", ["a", "b"]), ("t.csv", ["1", 'x, "y"']), ("t.csv", ["2", None])]
    assert sheets.cells(spark, f"{folder}/b.xlsx").count() == 4
    with pytest.raises(ValueError):
        sheets.cells(spark, "t.ods")
