"""Workbooks made here by hand, read by the data source and through Spark's own file reader."""

import zipfile
from datetime import date
from xml.sax.saxutils import escape

import pytest

from quern.sources import workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make(path, pages, shared=(), styles=""):
    """pages: name -> rows' XML."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>" + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(pages, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(pages) + 1)) + "</Relationships>")
        for i, rows in enumerate(pages.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")


STYLES = '<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
HEAD = '<row r="1"><c r="A1" t="inlineStr"><is><t>who</t></is></c></row>'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    sapore = (
        HEAD
        + '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><v>7.5</v></c><c r="C2" s="1"><v>43831</v></c><c r="D2" t="s"><v>1</v></c><c r="E2"><v>99</v></c></row>'
        + '<row r="4"><c r="B4" t="str"><f>1+1</f><v>2,5</v></c><c r="C4" s="2"><v>43832.5</v></c></row>'
        + '<row r="5"><c r="A5"/><c r="B5" t="e"><v>#N/A</v></c></row>'
        + '<row><c t="b"><v>1</v></c><c s="3"><v>3</v></c></row>'
    )
    make(root / "one.xlsx", {" SAPORE ": sapore, "Istruzioni": HEAD + '<row r="2"><c r="A2"><v>1</v></c></row>', "Odore": HEAD}, ["<t>P1</t>", "<r><t xml:space=\"preserve\">buono </t></r><r><t>assai</t></r><rPh><t>x</t></rPh>"], STYLES)
    (root / "sub").mkdir()
    many = HEAD + "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="AA{i}"><v>5</v></c></row>' for i in range(2, 9002))
    make(root / "sub/two.xlsx", {"odore": many})
    return root


SCHEMA = "who string, score double, day date, note string, sheet string, row int"
WANT = [("P1", 7.5, date(2020, 1, 1), "buono assai", " SAPORE ", 2), (None, 2.5, date(2020, 1, 2), None, " SAPORE ", 4), ("TRUE", 3.0, None, None, " SAPORE ", 6)]


def test_data_source(spark, folder):
    spark.dataSource.register(workbook.WorkbookSource)
    df = spark.read.format("workbook").schema(SCHEMA).option("sheets", "Sapore,odore").load(str(folder))
    assert df.rdd.getNumPartitions() == 3  # a sheet of a file each
    got = [tuple(r) for r in df.filter("sheet like '%SAPORE%'").orderBy("row").collect()]
    assert got == WANT
    assert df.filter("sheet = 'odore'").selectExpr("count(*)", "min(who)", "max(row)").first() == (9000, "10", 9001)
    one = spark.read.format("workbook").schema("file string, n long").option("skip", 0).load(str(folder / "one.xlsx"))
    assert {r.n for r in one.collect()} == {None, 1} and {r.file for r in one.collect()} == {str(folder / "one.xlsx")}
    none = spark.read.format("workbook").schema(SCHEMA).option("sheets", "absent").load(str(folder))
    assert none.count() == 0
    with pytest.raises(Exception, match="no workbook"):
        spark.read.format("workbook").schema(SCHEMA).load(str(folder / "missing")).count()


def test_any_store(spark, folder):
    df = workbook.read_workbooks(spark, str(folder), SCHEMA, "sapore,odore")
    assert [tuple(r) for r in df.filter("sheet like '%SAPORE%'").orderBy("row").collect()] == WANT and df.count() == 9003
    assert workbook.read_workbooks(spark, str(folder), "a int, file string").groupBy("file").count().count() == 2


def test_places_and_types():
    assert [workbook._column(x) for x in ("A1", "Z9", "AA10", "BC3")] == [0, 25, 26, 54]
    from pyspark.sql import types as T

    assert [workbook._as(T.IntegerType(), v) for v in ("3", "3,0", "3.5", "x", True, 4)] == [3, 3, None, None, 1, 4]
