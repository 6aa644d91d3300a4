"""Spreadsheet source: the first sheet's first two columns, read with the standard library.

    spark.dataSource.register(XlsxSource)
    spark.read.format("xlsx_sheet").load(path)   # row_no, paragraph, raw_codes; the header is checked
    spark.read.format("xlsx_sheet").option("fileName", "true").load("s3://bucket/sheets")   # and file_name, the path

A path is a file, a folder (its .xlsx files, those of folders below too) or a pattern with * ? [ ]. Every file is a partition of its own: files are
small by the upload limit. Cells give what they display: strings, booleans, and numbers under their formats
(cellformat.py). A formula gives its text. A part of a file that unpacks to more than `maxPartBytes` is refused before it is in memory, whatever size
the file states for it. Paths may name any file system that Arrow opens; read_sheets() and read_bytes() take those that only Spark reads.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kindred import errors as E
from kindred.sources.cellformat import BUILT_IN, display

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROWS = "row_no int, paragraph string, raw_codes string"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def check_upload(name: str | None, data: bytes | None, max_bytes: int = 20 * 1024 * 1024) -> None:
    if not data:
        raise E.EngineError(E.MSG_FILE_EMPTY)
    if name is None or not name.lower().endswith(".xlsx"):
        raise E.EngineError(E.MSG_FILE_TYPE)
    if len(data) > max_bytes:
        raise E.EngineError(f"file larger than {max_bytes} bytes")


def _trim(s: str) -> str:
    return s.strip("".join(map(chr, range(33))))


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _formats(data: bytes | None) -> list[str | None]:
    """The format code of each cell style."""
    if not data:
        return []
    root = ElementTree.fromstring(data)
    own = {int(n.get("numFmtId")): n.get("formatCode") for n in root.iter(f"{_MAIN}numFmt")}
    styles = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId") or 0) for x in styles] if styles is not None else []
    return [own.get(i, BUILT_IN.get(i)) for i in ids]


def _value(cell, shared: list[str], formats: list[str | None], since_1904: bool) -> str:
    formula = cell.find(f"{_MAIN}f")
    if formula is not None and formula.text:
        return formula.text
    kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _text(cell)
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "TRUE" if v.text == "1" else "FALSE"
    if kind in ("str", "e"):
        return v.text
    style = int(cell.get("s") or 0)
    return display(float(v.text), formats[style] if style < len(formats) else None, since_1904)


#: Bytes that a part of a file may unpack to: ten times the upload limit.
MAX_PART = 200 * 1024 * 1024


def _part(z: zipfile.ZipFile, name: str, most: int) -> bytes:
    """A part of the file, refused beyond `most` bytes: by the size it states, and by what it really unpacks to."""
    if z.getinfo(name).file_size <= most:
        with z.open(name) as f:
            data = f.read(most + 1)
        if len(data) <= most:
            return data
    raise E.EngineError(f"{E.MSG_FILE_BROKEN}: {name} unpacks to more than {most} bytes")


def read_sheet(data: bytes, max_part: int = MAX_PART) -> list[tuple[int, str, str]]:
    """(row number, first cell, second cell) of every stored row of the first sheet, trimmed."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            read = lambda name: _part(z, name, max_part)
            book = ElementTree.fromstring(read("xl/workbook.xml"))
            sheet = book.find(f"{_MAIN}sheets/{_MAIN}sheet")
            if sheet is None:
                raise E.EngineError(E.MSG_NO_SHEET)
            links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(read("xl/_rels/workbook.xml.rels"))}
            target = links[sheet.get(f"{_REL}id")]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = [_text(s) for s in ElementTree.fromstring(read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
            formats = _formats(read("xl/styles.xml") if "xl/styles.xml" in names else None)
            about = book.find(f"{_MAIN}workbookPr")
            since_1904 = about is not None and about.get("date1904") in ("1", "true")
            rows, at = [], 0
            for row in ElementTree.fromstring(read(path)).iter(f"{_MAIN}row"):
                at = int(row.get("r") or at + 1)
                cells, column = {}, 0
                for c in row.iter(f"{_MAIN}c"):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    if letters:
                        column = 0
                        for ch in letters[0]:
                            column = column * 26 + ord(ch) - 64
                    else:
                        column += 1
                    if column <= 2:
                        cells[column] = _trim(_value(c, shared, formats, since_1904))
                rows.append((at, cells.get(1, ""), cells.get(2, "")))
            return rows
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, KeyError, ElementTree.ParseError, ValueError, IndexError) as e:
        raise E.EngineError(E.MSG_FILE_BROKEN) from e


def data_rows(rows: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    """Rows under a checked header."""
    head = next((r for r in rows if r[0] == 1), None)
    if head is None or head[1:] != (E.HEADER_PARAGRAPH, E.HEADER_CODES):
        raise E.EngineError(E.MSG_HEADER)
    return [r for r in rows if r[0] > 1]


def read_bytes(spark: SparkSession, path: str) -> tuple[str, bytes]:
    """Name and content of one file, through Spark's own file systems."""
    row = spark.read.format("binaryFile").load(path).select("path", "content").first()
    return row.path.rsplit("/", 1)[-1], bytes(row.content)


def read_sheets(spark: SparkSession, path: str, max_part: int = MAX_PART) -> DataFrame:
    """(file_name, row_no, paragraph, raw_codes) of the files of a folder or pattern in any file system that Spark reads; Spark
    packs small files into partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield _batch(name, content.as_py(), max_part)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, f"file_name string, {ROWS}")


def _batch(name: str, data: bytes, max_part: int) -> pa.RecordBatch:
    check_upload(name, data)
    rows = data_rows(read_sheet(data, max_part))
    columns = [pa.array([name] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.string())))]
    return pa.RecordBatch.from_arrays(columns, ["file_name", "row_no", "paragraph", "raw_codes"])


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, path: str, file_name: bool, max_part: int):
        self.path, self.file_name, self.max_part = path, file_name, max_part

    def partitions(self):
        """A partition for each file, in order of the paths."""
        from pyarrow import fs

        # a pattern's first folder without signs is where the search begins
        head = re.split(r"[*?\[]", self.path)[0]
        plain = head == self.path
        system, root = _system(head if plain else head.rpartition("/")[0] or "/")
        start = self.path[: len(self.path if plain else head.rpartition("/")[0]) - len(root)] if "://" in self.path else ""
        info = system.get_file_info([root])[0]
        if plain and info.type == fs.FileType.File:
            return [_File(self.path)]
        if info.type != fs.FileType.Directory:
            raise FileNotFoundError(self.path)
        found = sorted(f"{start}{x.path}" for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File)
        if plain:
            return [_File(p) for p in found if p.lower().endswith(".xlsx")]
        depth = self.path.count("/")
        return [_File(p) for p in found if p.count("/") == depth and all(map(fnmatchcase, p.split("/"), self.path.split("/")))]

    def read(self, partition):
        system, path = _system(partition.path)
        with system.open_input_file(path) as f:
            batch = _batch(partition.path, f.read(), self.max_part)
        yield batch.select(["row_no", "paragraph", "raw_codes", *(["file_name"] if self.file_name else [])])


class XlsxSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx_sheet"

    def _named(self) -> bool:
        return self.options.get("fileName", "false").lower() == "true"

    def schema(self):
        return ROWS + (", file_name string" if self._named() else "")

    def reader(self, schema):
        return _Reader(self.options["path"], self._named(), int(self.options.get("maxPartBytes", MAX_PART)))


def write_sheet(rows: list[tuple[str, str]], header: tuple[str, str] = (E.HEADER_PARAGRAPH, E.HEADER_CODES)) -> bytes:
    """A minimal workbook with inline strings, for export and tests."""
    from xml.sax.saxutils import escape

    body = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{c}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in zip("AB", r)) + "</row>"
        for i, r in enumerate([header, *rows], 1)
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
