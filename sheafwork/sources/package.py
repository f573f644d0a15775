"""The parts of one workbook file, read one after another: nothing is held but shared texts, formats and one row."""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyarrow import fs

#: Number formats that files name by number alone.
BUILT_IN = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy",
    16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)",
    38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
_LITERAL = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.')


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store that holds a path (local, or any that Arrow knows by its scheme) and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[str]:
    """Workbooks at or below a path, sorted; lock files of open workbooks are none."""
    store, inner = file_system(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: path.index(inner)] if inner in path else ""
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(prefix + f.path for f in found if f.is_file and f.path.endswith(".xlsx") and not f.base_name.startswith("~$"))


def tag(element) -> str:
    return element.tag.rpartition("}")[2]


def inside(element, *names: str):
    """Children of children by local names, whatever their namespaces."""
    found = [element]
    for name in names:
        found = [c for e in found for c in e if tag(c) == name]
    return found


def attribute(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n


def corners(ref: str) -> tuple[int, int, int, int]:
    """First row, last row, first column, last column (from 1) of a range such as B2:D9, $A$1 or Sheet!B2:B9."""
    ends = re.findall(r"([A-Za-z]{1,3})(\d+)", ref.rpartition("!")[2].replace("$", ""))
    if not ends:
        raise ValueError(f"no range of cells: {ref}")
    rows, columns = [int(r) for _, r in ends], [column_number(c) for c, _ in ends]
    return min(rows), max(rows), min(columns), max(columns)


def is_date_format(code: str | None) -> bool:
    return code is not None and code != "General" and any(ch in _LITERAL.sub("", code).lower() for ch in "ymdhs")


class Package:
    def __init__(self, path: str):
        self.path = path
        store, inner = file_system(path)
        self._file = store.open_input_file(inner)
        self.zip = zipfile.ZipFile(self._file)
        self.parts = set(self.zip.namelist())

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.zip.close()
        self._file.close()

    def root(self, part: str):
        return ElementTree.fromstring(self.zip.read(part))

    def links(self, part: str) -> dict[str, tuple[str, str]]:
        """What a part is related to: id -> (kind, part)."""
        folder, name = posixpath.split(part)
        rels = f"{folder}/_rels/{name}.rels"
        if rels not in self.parts:
            return {}
        out = {}
        for r in self.root(rels):
            target = r.get("Target", "")
            out[r.get("Id")] = r.get("Type", "").rpartition("/")[2], target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        return out

    def related(self, part: str, kind: str) -> list[str]:
        return [target for of, target in self.links(part).values() if of == kind and target in self.parts]

    def sheets(self) -> list[tuple[str, str, bool]]:
        """(name, part, hidden) in the workbook's order."""
        links = self.links("xl/workbook.xml")
        return [(s.get("name"), links[attribute(s, "id")][1], s.get("state", "visible") != "visible") for s in inside(self.root("xl/workbook.xml"), "sheets", "sheet")]

    def strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.parts:
            return []
        out = []
        with self.zip.open("xl/sharedStrings.xml") as stream:
            for _, e in ElementTree.iterparse(stream):
                if tag(e) == "si":
                    out.append("".join(t.text or "" for r in e for t in ([r] if tag(r) == "t" else inside(r, "t") if tag(r) == "r" else [])))
                    e.clear()
        return out

    def formats(self) -> list[str | None]:
        """The number format of each cell style; None for the general one."""
        if "xl/styles.xml" not in self.parts:
            return []
        root = self.root("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in inside(root, "numFmts", "numFmt")}
        codes = [own.get(n, BUILT_IN.get(n)) for n in (int(x.get("numFmtId", 0)) for x in inside(root, "cellXfs", "xf"))]
        return [None if c == "General" else c for c in codes]

    def epoch(self) -> datetime:
        mac = any(p.get("date1904") in ("1", "true") for p in inside(self.root("xl/workbook.xml"), "workbookPr"))
        return datetime(1904, 1, 1) if mac else datetime(1899, 12, 30)

    def rows(self, part: str, last: int | None = None) -> Iterator[tuple[int, list, list, list, list]]:
        """(row number, cells, formulas, formats, kinds) of a sheet, from a stream; stops after row `last`.

        Cells are texts, null where empty; dates and times in ISO form. Kinds: number, text, boolean, date, error, formula.
        """
        strings, formats, epoch, row = self.strings(), self.formats(), self.epoch(), 0
        with self.zip.open(part) as stream:
            body = None
            for event, e in ElementTree.iterparse(stream, ("start", "end")):
                if event == "start":
                    body = e if tag(e) == "sheetData" else body
                    continue
                if tag(e) == "sheetData":
                    return
                if tag(e) != "row":
                    continue
                row = int(e.get("r") or row + 1)
                if last is not None and row > last:
                    return
                cells: dict[int, tuple] = {}
                at = 0
                for c in inside(e, "c"):
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    at = column_number(letters[0]) if letters else at + 1
                    cells[at] = _cell(c, strings, formats, epoch)
                width = max((k for k, v in cells.items() if v[0] is not None or v[1] is not None), default=0)
                whole = [cells.get(k, (None,) * 4) for k in range(1, width + 1)]
                yield row, *[list(x) for x in (zip(*whole) if whole else ([],) * 4)]
                body.clear()

    def after_rows(self, part: str, name: str) -> Iterator:
        """Elements of a sheet by name, from a stream that forgets the rows."""
        with self.zip.open(part) as stream:
            for _, e in ElementTree.iterparse(stream):
                if tag(e) == name:
                    yield e
                elif tag(e) == "row":
                    e.clear()


def _cell(c, strings: list[str], formats: list, epoch: datetime) -> tuple[str | None, str | None, str | None, str | None]:
    value = next(iter(inside(c, "v")), None)
    formula = next(iter(inside(c, "f")), None)
    style = int(c.get("s") or 0)
    code = formats[style] if style < len(formats) else None
    kind, text = c.get("t"), value.text if value is not None else None
    if kind == "s" and text is not None:
        text, of = strings[int(text)], "text"
    elif kind == "inlineStr":
        text, of = "".join(t.text or "" for t in c.iter() if tag(t) == "t"), "text"
    elif kind == "b" and text is not None:
        text, of = "true" if text == "1" else "false", "boolean"
    elif kind == "e":
        of = "error"
    elif kind in ("str", "d"):
        of = "date" if kind == "d" else "text"
    else:
        of = "number"
        if text is not None and is_date_format(code):
            moment = epoch + timedelta(seconds=round(float(text) * 86_400))
            text, of = moment.isoformat() if moment.time().isoformat() != "00:00:00" else moment.date().isoformat(), "date"
    written = "=" + formula.text if formula is not None and formula.text else None
    return text, written, code, "formula" if written else of if text is not None else None
