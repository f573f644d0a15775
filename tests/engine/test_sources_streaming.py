"""Readers, writers and streams."""

import time
import zipfile

import pytest
from pyspark.sql import functions as F

from sheafwork.sources import readers, writers
from sheafwork.streaming import events

SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="inlineStr"><is><t>Report</t></is></c></row>
<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="s"><v>1</v></c></row>
<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>10</v></c><c r="D3"><f>[1]Other!A1+B3</f><v>#REF!</v></c></row>
<row r="4"/><row r="5"><c r="A5" t="inlineStr"><is><t>Y</t></is></c><c r="B5"><v>20</v></c></row></sheetData></worksheet>"""


def workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Name</t></si><si><t>Value</t></si><si><t>X</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET)


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    raw = readers.read_workbooks(spark, str(tmp_path)).cache()
    assert raw.where("error is not null").count() == 1
    name = raw.where("error is null").first().file_name
    out = readers.sheet_table(raw, name, "Data")
    assert out.columns == ["row_idx", "Name", "Value", "Column_C", "Value_2"]
    assert [(r.row_idx, r.Name, r.Value) for r in out.orderBy("row_idx").collect()] == [(0, "X", "10"), (2, "Y", "20")]
    assert {r["column"]: r.kind for r in readers.infer_types(out.drop("row_idx")).collect()} == {"Name": "text", "Value": "numeric", "Column_C": "text", "Value_2": "text"}
    f = readers.formula_cells(raw).first()
    assert f.external and f.error == "#REF!" and f.row_idx == 3
    raw.unpersist()


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1, 2], True)], "a int, b string, c array<int>, d boolean")
    writers.export(df, f"{tmp_path}/c", "csv")
    row = spark.read.csv(f"{tmp_path}/c", header=True).first()
    assert row.c == "[1,2]" and row.d == "true" and not row.b
    writers.export(df, f"{tmp_path}/j", "json", metadata={"q": 1})
    assert spark.read.json(f"{tmp_path}/j").first()._metadata == '{"q": 1}'
    with pytest.raises(ValueError):
        writers.export(df.limit(0), f"{tmp_path}/e")
    with pytest.raises(ValueError):
        writers.export(spark.range(5), f"{tmp_path}/e", limit=3)
    assert writers.column_role("unit_price") == "currency" and writers.column_role("growth_rate") == "percentage"


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = events.tumbling(stream, late="10000 days").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    key = lambda d: sorted((str(r.window_start), r.event_type, r.n) for r in d.collect())
    assert key(spark.table("tumbled")) == key(events.tumbling(source))


def test_session_state(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(5)] + [(2, 0, "user", "only")], "conv_id long, turn long, role string, text string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = events.conversation_state(stream, keep=2).writeStream.format("memory").queryName("state").outputMode("update").start()
    deadline = time.time() + 60  # a query with time-outs never ends by itself
    while spark.table("state").count() < 2 and time.time() < deadline:
        query.awaitTermination(1)
    query.stop()
    assert {r.conv_id: (r.n_messages, r.last_texts) for r in spark.table("state").collect()} == {1: (5, ["m3", "m4"]), 2: (1, ["only"])}


def test_index_new_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    for i in range(2):
        df.withColumn("id", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/in")
        events.index_new_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", "id int, t string")
        assert spark.read.parquet(f"{tmp_path}/out").count() == i + 1
