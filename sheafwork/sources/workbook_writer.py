"""The workbook sink: tasks write rows of sheets as chunks of XML beside the target, the commit streams them into one file.

Options: `sheet` (name, default Export), `sheetBy` (a column whose values name the sheets; it is not written), `merge` (columns, separated by commas, in
which equal values one below the other become one merged cell), `sheetRows` (rows after which a sheet goes on in a further one). Types are kept: numbers, booleans, dates and times
as such, with number formats by the column's role; nested values are JSON texts. Sheets over a workbook's row limit go on in
further sheets. Rows come in the order of the partitions; sort before writing for an order of your own.

A task that fails or runs twice leaves chunks that no message names; the commit takes only what messages name and replaces the target at the end.
The driver copies bytes of chunks from stream to stream and holds the messages alone: a few numbers for each chunk and range.
"""

from __future__ import annotations

import json
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .package import file_system
from .writers import column_role

CHUNK_ROWS, SHEET_ROWS, WIDEST, MEASURED = 1 << 16, 1_048_576, 50, 98
#: Cell styles of every written file, by place in cellXfs.
PLAIN, HEADER, CURRENCY, PERCENT, MOMENT, DAY = range(6)
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_STYLES = (
    f'<styleSheet xmlns="{_MAIN}"><numFmts count="3"><numFmt numFmtId="164" formatCode="&quot;$&quot;#,##0.00"/>'
    '<numFmt numFmtId="165" formatCode="yyyy-mm-dd hh:mm:ss"/><numFmt numFmtId="166" formatCode="yyyy-mm-dd"/></numFmts>'
    '<fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    '<fill><patternFill patternType="solid"><fgColor rgb="FFCCCCCC"/></patternFill></fill></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="6"><xf numFmtId="0"/><xf numFmtId="0" fontId="1" fillId="2" applyFont="1" applyFill="1"><alignment horizontal="center"/></xf>'
    + "".join(f'<xf numFmtId="{n}" applyNumberFormat="1"/>' for n in (164, 10, 165, 166))
    + "</cellXfs></styleSheet>"
)
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


@dataclass
class Chunk:
    sheet: str
    file: str
    rows: int
    merges: list[tuple[int, int, int]] = field(default_factory=list)


@dataclass
class Chunks(WriterCommitMessage):
    partition: int
    chunks: list[Chunk]
    widths: dict[str, list[int]]


def column_letters(n: int) -> str:
    return (column_letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)


def _inline(text: str, style: int = PLAIN) -> str:
    styled = f' s="{style}"' if style else ""
    return f'<c t="inlineStr"{styled}><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", text))}</t></is></c>'


def _cell(value, style: int) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, datetime):
        days = (value.replace(tzinfo=None) - datetime(1899, 12, 30)).total_seconds() / 86_400
        return f'<c s="{MOMENT}"><v>{days!r}</v></c>'
    if isinstance(value, date):
        return f'<c s="{DAY}"><v>{(value - date(1899, 12, 30)).days}</v></c>'
    if isinstance(value, (list, dict)):
        return _inline(json.dumps(value, default=str, ensure_ascii=False))
    if isinstance(value, (bytes, str)):
        return _inline(value.decode("utf-8", "replace") if isinstance(value, bytes) else value)
    if value != value or value in (float("inf"), float("-inf")):
        return _inline(str(value))
    return f'<c s="{style}"><v>{value}</v></c>' if style else f"<c><v>{value}</v></c>"


class _Sheet:
    """The chunk of one sheet that a task is writing."""

    def __init__(self, store: fs.FileSystem, folder: str, name: str):
        self.chunk = Chunk(name, f"{folder}/{uuid.uuid4().hex}.xml", 0)
        self.out, self.last = store.open_output_stream(self.chunk.file), {}

    def write(self, xml: str, values: dict[int, object]) -> None:
        row, self.chunk.rows = self.chunk.rows, self.chunk.rows + 1
        for column, value in values.items():
            start, old = self.last.get(column, (row, value))
            if row and value != old:
                self._merge(column, start, row - 1, old)
                start = row
            self.last[column] = start, value
        self.out.write(xml.encode())

    def _merge(self, column: int, first: int, last: int, value) -> None:
        if last > first and value is not None:
            self.chunk.merges.append((column, first, last))

    def close(self) -> Chunk:
        for column, (start, value) in self.last.items():
            self._merge(column, start, self.chunk.rows - 1, value)
        self.out.close()
        return self.chunk


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path = options["path"]
        if not self.path.endswith(".xlsx"):
            raise ValueError("a workbook's path ends with .xlsx")
        self.sheet, self.by = options.get("sheet", "Export"), options.get("sheetby")
        names = schema.names
        self.sheet_rows = min(int(options.get("sheetrows", SHEET_ROWS)), SHEET_ROWS)
        if self.by is not None and self.by not in names:
            raise ValueError(f"no column {self.by}")
        self.columns = [i for i, n in enumerate(names) if n != self.by]
        self.names = [names[i] for i in self.columns]
        merge = [m.strip() for m in options.get("merge", "").split(",") if m.strip()]
        self.merge = [self.names.index(m) for m in merge]
        self.styles = [{"currency": CURRENCY, "percentage": PERCENT}.get(column_role(n), PLAIN) for n in self.names]
        self.by_at = names.index(self.by) if self.by else None
        store, inner = file_system(self.path)
        if not overwrite and store.get_file_info(inner).type != fs.FileType.NotFound:
            raise FileExistsError(self.path)
        self.folder = f"{inner}.parts-{uuid.uuid4().hex}"
        store.create_dir(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Chunks:
        store, _ = file_system(self.path)
        context = TaskContext.get()
        done, open_, widths = [], {}, {}
        for batch in iterator:
            columns = [batch.column(i).to_pylist() for i in self.columns]
            sheets = batch.column(self.by_at).to_pylist() if self.by else [self.sheet] * batch.num_rows
            for sheet, row in zip(sheets, zip(*columns) if columns else [()] * batch.num_rows):
                sheet = "None" if sheet is None else str(sheet)
                at = open_.get(sheet)
                if at is None or at.chunk.rows == min(CHUNK_ROWS, max(self.sheet_rows - 1, 1)):
                    if at:
                        done.append(at.close())
                    at = open_[sheet] = _Sheet(store, self.folder, sheet)
                if at.chunk.rows < MEASURED:
                    widest = widths.setdefault(sheet, [0] * len(row))
                    widths[sheet] = [max(w, len(str(v)) if v is not None else 0) for w, v in zip(widest, row)]
                at.write("<row>" + "".join(map(_cell, row, self.styles)) + "</row>", {c: row[c] for c in self.merge})
        done += [at.close() for at in open_.values()]
        return Chunks(context.partitionId() if context else 0, done, widths)

    def commit(self, messages: list) -> None:
        store, inner = file_system(self.path)
        found = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        sheets: dict[str, list[Chunk]] = {}
        for m in found:
            for c in m.chunks:
                sheets.setdefault(c.sheet, []).append(c)
        if self.by is None:
            sheets.setdefault(self.sheet, [])
        books = [(name, part) for name, chunks in (sorted(sheets.items()) or [(self.sheet, [])]) for part in _within_limit(chunks, self.sheet_rows)]
        titles = _titles([name for name, _ in books])
        new = f"{self.folder}/book.xlsx"
        with store.open_output_stream(new) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            for i, (name, chunks) in enumerate(books):
                widths = next((m.widths[name] for m in found if name in m.widths), [0] * len(self.names))
                with book.open(f"xl/worksheets/sheet{i + 1}.xml", "w", force_zip64=True) as sheet:
                    self._sheet(store, sheet, chunks, widths)
            for part, text in _frame(titles).items():
                book.writestr(part, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        store.move(new, inner)
        store.delete_dir(self.folder)

    def _sheet(self, store: fs.FileSystem, out, chunks: list[Chunk], widths: list[int]) -> None:
        fitted = [min(max(w, len(n)) + 2, WIDEST) for w, n in zip(widths, self.names)]
        columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(fitted, 1))
        head = f'<worksheet xmlns="{_MAIN}">' + (f"<cols>{columns}</cols>" if columns else "")
        out.write((head + "<sheetData><row>" + "".join(_inline(n, HEADER) for n in self.names) + "</row>").encode())
        row, merges = 2, []
        for c in chunks:
            with store.open_input_stream(c.file) as rows:
                shutil.copyfileobj(rows, out, 1 << 20)
            merges += [f'<mergeCell ref="{column_letters(k + 1)}{row + a}:{column_letters(k + 1)}{row + b}"/>' for k, a, b in c.merges]
            row += c.rows
        tail = f'<mergeCells count="{len(merges)}">{"".join(merges)}</mergeCells>' if merges else ""
        out.write(f"</sheetData>{tail}</worksheet>".encode())

    def abort(self, messages: list) -> None:
        store, _ = file_system(self.path)
        store.delete_dir(self.folder)


def _within_limit(chunks: list[Chunk], limit: int | None = None) -> list[list[Chunk]]:
    """Chunks of one sheet after another, none with more rows than a sheet may hold with its header."""
    out, rows = [[]], 0
    for c in chunks:
        if out[-1] and rows + c.rows >= (limit or SHEET_ROWS):
            out.append([])
            rows = 0
        out[-1].append(c)
        rows += c.rows
    return out


def _titles(names: list[str]) -> list[str]:
    """Sheet names as workbooks allow them: 31 characters, none of []:*?/\\, no two alike."""
    out: list[str] = []
    taken: set[str] = set()
    last: dict[str, int] = {}
    for name in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"
        title, n = base, last.get(base, 1)
        while title.lower() in taken:
            n += 1
            title = f"{base[: 30 - len(str(n))]}_{n}"
        last[base] = n
        taken.add(title.lower())
        out.append(title)
    return out


def _frame(titles: list[str]) -> dict[str, str]:
    """The parts around the sheets."""
    package = "http://schemas.openxmlformats.org/package/2006"
    numbers = range(1, len(titles) + 1)
    sheets = "".join(f'<sheet name={quoteattr(t)} sheetId="{i}" r:id="rId{i}"/>' for i, t in zip(numbers, titles))
    links = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in numbers)
    return {
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">{links}<Relationship Id="rId{len(titles) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": _STYLES,
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>{types}'
        f'<Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/></Types>',
    }
