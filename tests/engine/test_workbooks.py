"""The workbook source and sink: sheets as tasks, pushed filters, child frames, merged ranges, pivots, round trips."""

import random
import zipfile
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import sheets
from sheafwork.sources import package, readers, workbook, writers

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SALES = [("North", "Q1", 10), ("North", "Q2", 20), ("South", "Q1", 5), ("South", "Q1", 7), ("South", "Q2", 1)]


def links(*targets) -> str:
    body = "".join(f'<Relationship Id="rId{i}" Type="{REL}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(targets, 1))
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'


def cell(ref, value, style=0):
    if isinstance(value, str):
        return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
    return f'<c r="{ref}" s="{style}"><v>{value}</v></c>'


def rich_workbook(path):
    """Two sheets and a hidden one; merged ranges, formats, names, a table, a pivot with its cached cells, a chart."""
    rows = "".join(f'<row r="{i}">{cell(f"A{i}", a)}{cell(f"B{i}", b)}{cell(f"C{i}", c)}</row>' for i, (a, b, c) in enumerate([("Region", "Quarter", "Amount"), *SALES], 1))
    pivot_cells = [("Region", "Q1", "Q2", "Total"), ("North", 10, 20, 30), ("South", 12, 1, 13), ("Total", 22, 21, 43)]
    cached = "".join(f'<row r="{i}">' + "".join(cell(f"{'ABCD'[j]}{i}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(pivot_cells, 3))
    formats = f'<row r="10">{cell("A10", 45306.4375, 1)}{cell("B10", 45306, 2)}{cell("C10", 0.75, 3)}{cell("D10", 1234.56, 4)}<c r="E10" t="b"><v>1</v></c><c r="F10" t="e"><v>#N/A</v></c><c r="G10"><f>A1+1</f><v>2</v></c></row>'
    styles = "".join(f'<xf numFmtId="{n}"/>' for n in (0, 22, 170, 10, 171))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Pivot" sheetId="2" r:id="rId2"/><sheet name="Old" sheetId="3" state="hidden" r:id="rId3"/></sheets><definedNames><definedName name="Amounts">Data!$C$2:$C$6,Data!$A$1</definedName><definedName name="Mine" localSheetId="1">Pivot!$A$3</definedName><definedName name="_xlnm.Print_Area" localSheetId="0">Data!$A$1</definedName><definedName name="Gone">#REF!</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", links(("worksheet", "worksheets/sheet1.xml"), ("worksheet", "/xl/worksheets/sheet2.xml"), ("worksheet", "worksheets/sheet3.xml")))
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts count="2"><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="171" formatCode="[Red]&quot;day&quot;#,##0.00"/></numFmts><cellXfs>{styles}</cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {MAIN}><sheetData>{rows}</sheetData><mergeCells count="1"><mergeCell ref="A2:A3"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {MAIN}><sheetData>{cached}{formats}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet3.xml", f"<worksheet {MAIN}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", links(("table", "../tables/table1.xml"), ("drawing", "../drawings/drawing1.xml")))
        z.writestr("xl/tables/table1.xml", f'<table {MAIN} name="Sales" displayName="Sales" ref="A1:C6" totalsRowCount="0"><tableColumns><tableColumn name="Region"/><tableColumn name="Quarter"/><tableColumn name="Amount"/></tableColumns></table>')
        z.writestr("xl/drawings/_rels/drawing1.xml.rels", links(("chart", "../charts/chart1.xml")))
        z.writestr("xl/drawings/drawing1.xml", "<wsDr/>")
        z.writestr("xl/charts/chart1.xml", '<c:chartSpace xmlns:c="urn:c" xmlns:a="urn:a"><c:chart><c:title><c:tx><a:t>Amounts </a:t><a:t>by region</a:t></c:tx></c:title><c:plotArea><c:barChart><c:ser><c:tx><c:strRef><c:f>Data!$C$1</c:f></c:strRef></c:tx><c:cat><c:strRef><c:f>Data!$A$2:$A$6</c:f></c:strRef></c:cat><c:val><c:numRef><c:f>Data!$C$2:$C$6</c:f></c:numRef></c:val></c:ser></c:barChart><c:catAx><c:title><a:t>Region</a:t></c:title></c:catAx><c:valAx><c:title><a:t>USD</a:t></c:title></c:valAx></c:plotArea></c:chart></c:chartSpace>')
        z.writestr("xl/worksheets/_rels/sheet2.xml.rels", links(("pivotTable", "../pivotTables/pivotTable1.xml")))
        z.writestr("xl/pivotTables/pivotTable1.xml", f'<pivotTableDefinition {MAIN} name="ByRegion"><location ref="A3:D6"/><rowFields><field x="0"/></rowFields><colFields><field x="1"/><field x="-2"/></colFields><dataFields><dataField name="Sum of Amount" fld="2"/></dataFields></pivotTableDefinition>')
        z.writestr("xl/pivotTables/_rels/pivotTable1.xml.rels", links(("pivotCacheDefinition", "../pivotCache/pivotCacheDefinition1.xml")))
        z.writestr("xl/pivotCache/pivotCacheDefinition1.xml", f'<pivotCacheDefinition {MAIN}><cacheSource type="worksheet"><worksheetSource ref="A1:C6" sheet="Data"/></cacheSource><cacheFields><cacheField name="Region"/><cacheField name="Quarter"/><cacheField name="Amount"/></cacheFields></pivotCacheDefinition>')


@pytest.fixture(scope="module")
def books(tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    rich_workbook(folder / "rich.xlsx")
    (folder / "deep").mkdir()
    rich_workbook(folder / "deep" / "again.xlsx")
    (folder / "broken.xlsx").write_bytes(b"no zip")
    (folder / "~$rich.xlsx").write_bytes(b"lock")
    return str(folder)


def test_a_task_for_each_sheet(spark, books):
    rows = readers.read_workbooks(spark, f"{books}/rich.xlsx")
    assert rows.rdd.getNumPartitions() == 3
    found = {(r.sheet_name, r.row_idx): r for r in rows.collect()}
    assert found["Data", 2].cells == ["North", "Q1", "10"] and found["Data", 2].kinds == ["text", "text", "number"]
    last = found["Pivot", 10]
    assert last.cells == ["2024-01-15T10:30:00", "2024-01-15", "0.75", "1234.56", "true", "#N/A", "2"]
    assert last.kinds == ["date", "date", "number", "number", "boolean", "error", "formula"]
    assert last.formats[1:4] == ["yyyy\\-mm\\-dd", "0.00%", '[Red]"day"#,##0.00'] and last.formulas[6] == "=A1+1"


def test_filters_prune_files_sheets_and_rows(spark, books):
    rows = readers.read_workbooks(spark, books)
    assert rows.rdd.getNumPartitions() == 7
    one = rows.where((F.col("sheet_name") == "Data") & (F.col("row_idx") <= 2))
    assert one.rdd.getNumPartitions() == 3  # the broken file may hold any sheet
    assert one.count() == 4
    exact = rows.where((F.col("file_name") == f"{books}/rich.xlsx") & (F.col("sheet_name") == "Data"))
    assert exact.rdd.getNumPartitions() == 1 and exact.count() == 6
    assert rows.where(F.col("error").isNotNull()).select("file_name").collect()[0][0].endswith("broken.xlsx")


def test_children(spark, books):
    path = f"{books}/rich.xlsx"
    child = lambda content: [tuple(r)[1:] for r in readers.read_workbooks(spark, path, content).collect()]
    assert child("sheets") == [("Data", 0, False, None), ("Pivot", 1, False, None), ("Old", 2, True, None)]
    assert child("merged") == [("Data", 0, "A2:A3", 2, 3, 1, 1)]
    assert child("names") == [("Amounts", "workbook", None, "Data!$C$2:$C$6"), ("Mine", "sheet", "Pivot", "Pivot!$A$3")]
    assert child("tables") == [("Data", "Sales", "A1:C6", ["Region", "Quarter", "Amount"], 5)]
    assert child("pivots") == [("Pivot", "ByRegion", "A3:D6", "Data", "A1:C6", ["Region"], ["Quarter"], [], [("Sum of Amount", "Amount", "sum")])]
    assert child("charts") == [("Data", 0, "bar", "Amounts by region", "Region", "USD", [("Data!$C$1", "Data!$A$2:$A$6", "Data!$C$2:$C$6")])]


def test_table_and_pivot_equal_the_cached_cells(spark, books):
    path = f"{books}/rich.xlsx"
    definition = readers.read_workbooks(spark, path, "pivots").first()
    data = readers.read_workbooks(spark, path, "table", sheet=definition.source_sheet)
    assert data.columns == ["file_name", "row_idx", "Region", "Quarter", "Amount"] and data.count() == 5
    long = sheets.pivot(data, definition["rows"], definition["columns"], [tuple(v) for v in definition["values"]])
    shown = {r.Region or "Total": (r.Q1, r.Q2, r.Total) for r in sheets.pivot_wide(long, ["Region"], ["Quarter"], "Sum of Amount").collect()}
    cached = {r.cells[0]: tuple(map(float, r.cells[1:])) for r in readers.read_workbooks(spark, path).where("sheet_name = 'Pivot' and row_idx between 4 and 6").collect()}
    assert shown == cached == {"North": (10.0, 20.0, 30.0), "South": (12.0, 1.0, 13.0), "Total": (22.0, 21.0, 43.0)}
    no_south = sheets.pivot(data, ["Region"], ["Quarter"], [("n", "Amount", "count")], {"Region": ["North"]})
    assert sorted((r.n, r.row_total, r.column_total) for r in no_south.collect()) == [(1, False, False), (1, False, False), (1, True, False), (1, True, False), (2, False, True), (2, True, True)]


def test_merged_ranges_equal_a_plain_search(spark):
    rng = random.Random(4)
    rows, ranges = [], []
    for sheet in ("a", "b"):
        there = [r for r in range(1, 40) if rng.random() < 0.8]
        rows += [("f", sheet, r, [rng.choice([None, f"{sheet}{r}.{c}"]) for c in range(rng.randrange(0, 7))]) for r in there]
        for i in range(12):  # some overlap, some are one cell, some leave the sheet
            first, left = rng.randrange(1, 45), rng.randrange(1, 7)
            ranges.append(("f", sheet, i, "", first, first + rng.randrange(0, 6), left, left + rng.randrange(0, 4)))
    ranges.append(("f", "b", 12, "", 1, 10_000, 9, 9))
    df = spark.createDataFrame(rows, "file_name string, sheet_name string, row_idx long, cells array<string>")
    merged = spark.createDataFrame(ranges, workbook.SCHEMAS["merged"])
    at = {(s, r): cells for _, s, r, cells in rows}
    want = {k: list(v) for k, v in at.items()}
    for _, s, _, _, first, last, left, right in reversed(ranges):  # the first range counts, so it comes last
        corner = at.get((s, first), [])
        value = corner[left - 1] if left <= len(corner) else None
        for r in range(first, last + 1):
            cells = want.setdefault((s, r), [])
            cells += [None] * (right - len(cells))
            cells[left - 1 : right] = [value] * (right - left + 1)
    filled = sheets.fill_merged(df, merged)
    assert {(r.sheet_name, r.row_idx): r.cells for r in filled.collect()} == want
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_round_trip(spark, tmp_path):
    rows = [
        (1, "North", 2.5, True, date(2024, 1, 15), datetime(2024, 1, 15, 10, 30), Decimal("1.20"), [1, 2], "a & <b> \x01 'é'"),
        (2, "North", None, False, None, None, None, None, ""),
        (2**60, None, float("nan"), None, date(1999, 12, 31), datetime(1999, 1, 1, 0, 0), Decimal("-3.00"), [], " blank ends "),
    ]
    df = spark.createDataFrame(rows, "id long, name string, price double, ok boolean, day date, at timestamp, rate decimal(9,2), list array<int>, text string")
    path = f"{tmp_path}/out.xlsx"
    writers.export(df, path, "xlsx")
    back = readers.read_workbooks(spark, path).orderBy("row_idx").collect()
    assert back[0].cells == df.columns and len(back) == 4
    assert back[1].cells == ["1", "North", "2.5", "true", "2024-01-15", "2024-01-15T10:30:00", "1.20", "[1, 2]", "a & <b>  'é'"]
    assert back[1].kinds == ["number", "text", "number", "boolean", "date", "date", "number", "text", "text"]
    assert back[1].formats[2] == '"$"#,##0.00' and back[1].formats[6] == "0.00%"
    assert back[3].cells[0] == str(2**60) and back[3].cells[2] == "nan" and back[3].cells[8] == " blank ends "
    with pytest.raises(Exception, match="FileExists"):
        df.write.format("workbook").mode("append").save(path)
    df.limit(1).write.format("workbook").mode("overwrite").save(path)
    assert readers.read_workbooks(spark, path).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["out.xlsx"]
    with pytest.raises(Exception, match="xlsx"):
        df.write.format("workbook").mode("overwrite").save(f"{tmp_path}/out.csv")


def test_sheets_by_column_and_merged_labels(spark, tmp_path):
    workbook.register(spark)
    rows = [(f"part {i % 3}/x", i // 7, i) for i in range(300)]
    df = spark.createDataFrame(rows, "kind string, label int, n int").repartitionByRange(4, "kind", "n").sortWithinPartitions("kind", "n")
    path = f"{tmp_path}/by.xlsx"
    df.write.format("workbook").option("sheetBy", "kind").option("merge", "label").mode("overwrite").save(path)
    assert {r.sheet_name for r in readers.read_workbooks(spark, path, "sheets").collect()} == {"part 0_x", "part 1_x", "part 2_x"}
    merged = readers.read_workbooks(spark, path, "merged")
    assert merged.count() > 50
    filled = sheets.fill_merged(readers.read_workbooks(spark, path), merged).where("row_idx > 1")
    assert sorted((r.sheet_name.replace("_", "/"), int(r.cells[0]), int(r.cells[1])) for r in filled.collect()) == sorted(rows)


def test_empty_frame_and_names(spark, tmp_path):
    workbook.register(spark)
    path = f"{tmp_path}/none.xlsx"
    spark.createDataFrame([], "a int, b string").write.format("workbook").mode("overwrite").save(path)
    assert [r.cells for r in readers.read_workbooks(spark, path).collect()] == [["a", "b"]]
    assert readers.unique_names(["Name", "name", "", None, "NAME_2", "Name"]) == ["Name", "name_2", "Column_C", "Column_D", "NAME_2_2", "Name_3"]
    assert package.corners("Data!$B$2:$D$9") == (2, 9, 2, 4) and package.column_number("AA") == 27


def test_sheet_over_the_row_limit_goes_on_in_another(monkeypatch):
    from sheafwork.sources import workbook_writer as w

    monkeypatch.setattr(w, "SHEET_ROWS", 100)
    chunks = [w.Chunk("s", str(i), 40) for i in range(5)]
    assert [[c.file for c in part] for part in w._within_limit(chunks)] == [["0", "1"], ["2", "3"], ["4"]]
    assert w._titles(["a" * 40, "A" * 40, "b[1]", ""]) == ["a" * 31, "A" * 29 + "_2", "b_1_", "Sheet"]


def test_table_goes_on_in_further_sheets(spark, tmp_path):
    """a table of more rows than a sheet holds was read from its first sheet alone."""
    from sheafwork.sources import readers, workbook

    workbook.register(spark)
    path = f"{tmp_path}/long.xlsx"
    spark.range(0, 100, 1, 3).selectExpr("id", "concat('n', id) AS name").write.format("workbook").option("sheetRows", "11").mode("overwrite").save(path)
    one = readers.read_workbooks(spark, path, "table")
    every = readers.read_workbooks(spark, path, "table", continued="true")
    assert one.count() <= 10 and every.rdd.getNumPartitions() >= 10
    assert sorted(int(r.id) for r in every.collect()) == list(range(100))


def test_languages_of_sheets_over_the_row_limit(spark, monkeypatch, tmp_path):
    """titles are written by all tasks, and further sheets of a language are no languages."""
    from sheafwork.catalogue import workbooks

    monkeypatch.setattr(workbooks, "_book", lambda df, _book=workbooks._book, **options: _book(df, sheetRows="150", **options))
    docs = spark.createDataFrame([(i, f"word{i} more", "en" if i % 3 else "fr") for i in range(900)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = workbooks.QUERIES["sheet_languages"][0](spark, str(tmp_path)).collect()
    assert {r.sheet_name: r.language for r in found} == {"en": "en", "fr": "mixed"}
