"""Workbooks as a data source: ``spark.read.format("workbook")`` and ``df.write.format("workbook")``.

    workbook.register(spark)
    spark.read.format("workbook").load("/books")                                  # all rows of all sheets
    spark.read.format("workbook").option("content", "table").option("sheet", "Data").load("/books/a.xlsx")

Reading plans one partition for each sheet of each file and streams it; comparisons of file_name, sheet_name and row_idx
are pushed down: files and sheets that can't match are not opened for reading, and a stream ends at the last row asked for. The option
`content` names what is read from a workbook's parts: rows (default), table (one sheet under its header row),
sheets, merged, names, tables, pivots or charts. With the option `continued` a table goes on in the sheets right after its own that are
named like it with _2, _3 and so on, as the sink names what a sheet has no room for; each is read by a task of its own. Paths may lie in any store that Arrow opens by scheme.
A file that is no workbook gives one row with its `error` in rows and sheets, and nothing elsewhere.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .package import Package, corners, inside, list_files, tag

SCHEMAS = {
    "rows": "file_name string, sheet_name string, row_idx long, cells array<string>, formulas array<string>, formats array<string>, kinds array<string>, hidden boolean, error string",
    "sheets": "file_name string, sheet_name string, position int, hidden boolean, error string",
    "merged": "file_name string, sheet_name string, position int, ref string, first_row long, last_row long, first_column int, last_column int",
    "names": "file_name string, name string, scope string, sheet_name string, refers_to string",
    "tables": "file_name string, sheet_name string, name string, ref string, headers array<string>, row_count long",
    "pivots": "file_name string, sheet_name string, name string, location string, source_sheet string, source_ref string, rows array<string>, columns array<string>, filters array<string>, values array<struct<name:string,field:string,function:string>>",
    "charts": "file_name string, sheet_name string, position int, kind string, title string, x_title string, y_title string, series array<struct<name:string,categories:string,values:string>>",
}
BATCH = 2048
_BROKEN = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError, EOFError)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@dataclass
class SheetPartition(InputPartition):
    path: str
    sheet: str | None = None
    part: str | None = None
    position: int = 0
    hidden: bool = False
    error: str | None = None


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _content(self) -> str:
        content = self.options.get("content", "rows")
        if content != "table" and content not in SCHEMAS:
            raise ValueError(f"unknown content: {content}")
        return content

    def schema(self):
        content = self._content()
        if content != "table":
            return SCHEMAS[content]
        for path in list_files(self.options["path"]):
            with Package(path) as book:
                part = _pick(book, self.options.get("sheet"))
                if part:
                    _, names = header_of(book, part)
                    return StructType([StructField("file_name", StringType()), StructField("row_idx", LongType()), *[StructField(n, StringType()) for n in names]])
        raise ValueError("no workbook has that sheet")

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options, self._content(), schema)

    def writer(self, schema: StructType, overwrite: bool):
        from .workbook_writer import WorkbookWriter

        return WorkbookWriter(self.options, schema, overwrite)


def _pick(book: Package, sheet: str | None) -> str | None:
    """A sheet's part by name; without one, the first sheet that shows."""
    return next((part for name, part, hidden in book.sheets() if (name == sheet if sheet else not hidden)), None)


def _further(sheet: str, n: int) -> str:
    """What the sink calls the n-th sheet of a table."""
    return f"{sheet[: 30 - len(str(n))]}_{n}"


def header_of(book: Package, part: str) -> tuple[int, list[str]]:
    """Row number and unique names of the header: of rows 1 to 5 the first with most 2 x texts + filled cells."""
    from .readers import unique_names

    best, cells_of = (0, 0), []
    for row, cells, _, _, kinds in book.rows(part, 5):
        filled = [k for c, k in zip(cells, kinds) if c is not None and c.strip()]
        score = 2 * filled.count("text") + len(filled)
        if score > best[0]:
            best, cells_of = (score, row), cells
    return best[1], unique_names(cells_of)


class WorkbookReader(DataSourceReader):
    def __init__(self, options, content: str, schema: StructType):
        self.path, self.sheet, self.content, self.spark_schema = options["path"], options.get("sheet"), content, schema
        self.continued = str(options.get("continued", "false")).lower() == "true"
        self.files = self.sheets = None
        self.first, self.last = 1, None

    def pushFilters(self, filters):
        for f in filters:
            name, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            if isinstance(f, (EqualTo, In)) and name in ("file_name", "sheet_name"):
                found = set(value) if isinstance(f, In) else {value}
                slot = "files" if name == "file_name" else "sheets"
                old = getattr(self, slot)
                setattr(self, slot, found if old is None else old & found)
            elif name == "row_idx" and self.content == "rows" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    last = value - isinstance(f, LessThan)
                    self.last = last if self.last is None else min(self.last, last)
            yield f  # Spark tests the rows once more

    def _sheets(self, path: str) -> list[SheetPartition]:
        try:
            with Package(path) as book:
                if self.content == "names":
                    return [SheetPartition(path)]
                own = [SheetPartition(path, name, part, i, hidden) for i, (name, part, hidden) in enumerate(book.sheets())]
                if self.content == "table":
                    part = _pick(book, self.sheet)
                    first = next((i for i, s in enumerate(own) if s.part == part), len(own))
                    more = first + 1
                    while self.continued and more < len(own) and own[more].sheet == _further(own[first].sheet, more - first + 1):
                        more += 1
                    own = own[first:more]
        except _BROKEN as error:
            return [SheetPartition(path, error=f"{type(error).__name__}: {error}")]
        return [s for s in own if self.sheets is None or s.sheet in self.sheets]

    def partitions(self) -> list[SheetPartition]:
        paths = [p for p in list_files(self.path) if self.files is None or p in self.files]
        with ThreadPoolExecutor(16) as pool:
            return [s for own in pool.map(self._sheets, paths) for s in own] or [SheetPartition("")]

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        rows, schema, held = self._rows(partition) if partition.path else iter(()), to_arrow_schema(self.spark_schema), []
        for row in rows:
            held.append(row)
            if len(held) == BATCH:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    def _rows(self, p: SheetPartition) -> Iterator[tuple]:
        width = len(self.spark_schema)
        if p.error is not None:
            if self.content in ("rows", "sheets"):
                yield (p.path, *[None] * (width - 2), p.error)
            return
        if self.content == "sheets":
            yield p.path, p.sheet, p.position, p.hidden, None
            return
        with Package(p.path) as book:
            if self.content == "rows":
                try:
                    for row, *cells in book.rows(p.part, self.last):
                        if row >= self.first:
                            yield p.path, p.sheet, row, *cells, p.hidden, None
                except _BROKEN as error:
                    yield p.path, p.sheet, None, None, None, None, None, p.hidden, f"{type(error).__name__}: {error}"
            elif self.content == "table":
                header, names = header_of(book, p.part)
                place = {n: i for i, n in enumerate(names)}
                columns = [place.get(n, -1) for n in self.spark_schema.names[2:]]
                for row, cells, *_ in book.rows(p.part):
                    if row > header and any(c is not None and c.strip() for c in cells):
                        yield p.path, row - header - 1, *[cells[i] if 0 <= i < len(cells) else None for i in columns]
            else:
                yield from getattr(_Children, self.content)(book, p)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _text(element, *names: str) -> str | None:
    found = inside(element, *names)
    return found[0].text if found else None


class _Children:
    """Rows of the child frames: what a sheet's related parts describe."""

    @staticmethod
    def merged(book: Package, p: SheetPartition) -> Iterator[tuple]:
        for i, e in enumerate(book.after_rows(p.part, "mergeCell")):
            yield p.path, p.sheet, i, e.get("ref"), *corners(e.get("ref"))

    @staticmethod
    def names(book: Package, p: SheetPartition) -> Iterator[tuple]:
        sheets = [s for s, *_ in book.sheets()]
        for e in inside(book.root("xl/workbook.xml"), "definedNames", "definedName"):
            name, local, target = e.get("name"), e.get("localSheetId"), (e.text or "").split(",")[0]
            if not name.startswith("_xlnm") and "!" in target and "#REF" not in target:
                sheet = sheets[int(local)] if local is not None and int(local) < len(sheets) else None
                yield p.path, name, "workbook" if local is None else "sheet", sheet, target

    @staticmethod
    def tables(book: Package, p: SheetPartition) -> Iterator[tuple]:
        for part in book.related(p.part, "table"):
            t = book.root(part)
            first, last, *_ = corners(t.get("ref"))
            count = last - first + 1 - int(t.get("headerRowCount", 1)) - int(t.get("totalsRowCount", 0))
            yield p.path, p.sheet, t.get("displayName") or t.get("name"), t.get("ref"), [c.get("name") for c in inside(t, "tableColumns", "tableColumn")], max(count, 0)

    @staticmethod
    def pivots(book: Package, p: SheetPartition) -> Iterator[tuple]:
        for part in book.related(p.part, "pivotTable"):
            t, caches = book.root(part), book.related(part, "pivotCacheDefinition")
            cache = book.root(caches[0]) if caches else None
            source = next(iter(inside(cache, "cacheSource", "worksheetSource")), None) if cache is not None else None
            fields = [f.get("name") for f in inside(cache, "cacheFields", "cacheField")] if cache is not None else []
            named = lambda path, key: [fields[i] for i in (int(e.get(key, -1)) for e in inside(t, *path)) if 0 <= i < len(fields)]  # noqa: B023, E731
            values = []
            for e in inside(t, "dataFields", "dataField"):
                field, function = fields[int(e.get("fld"))], e.get("subtotal", "sum")
                values.append({"name": e.get("name") or f"{function.capitalize()} of {field}", "field": field, "function": function})
            where = (source.get("sheet"), source.get("ref") or source.get("name")) if source is not None else (None, None)
            location = next((e.get("ref") for e in inside(t, "location")), None)
            yield p.path, p.sheet, t.get("name"), location, *where, named(("rowFields", "field"), "x"), named(("colFields", "field"), "x"), named(("pageFields", "pageField"), "fld"), values

    @staticmethod
    def charts(book: Package, p: SheetPartition) -> Iterator[tuple]:
        drawn = [c for d in book.related(p.part, "drawing") for c in book.related(d, "chart")]
        for i, part in enumerate(drawn):
            chart = inside(book.root(part), "chart")[0]
            area = inside(chart, "plotArea")[0]
            title = lambda e: "".join(t.text or "" for x in inside(e, "title") for t in x.iter() if tag(t) == "t") or None
            axes = [title(a) for a in area if tag(a) in ("catAx", "dateAx")] + [title(a) for a in area if tag(a) == "valAx"]
            kinds = [e for e in area if tag(e).endswith("Chart")]
            series = []
            for s in (s for k in kinds for s in inside(k, "ser")):
                refs = {tag(e): next((f.text for f in e.iter() if tag(f) == "f"), None) for e in s}
                series.append({"name": _text(s, "tx", "v") or refs.get("tx"), "categories": refs.get("cat") or refs.get("xVal"), "values": refs.get("val") or refs.get("yVal")})
            kind = tag(kinds[0]).removesuffix("Chart").removesuffix("3D") if kinds else "unknown"
            yield p.path, p.sheet, i, kind, title(chart), axes[0] if axes else None, axes[1] if len(axes) > 1 else None, series

