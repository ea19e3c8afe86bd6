"""Workbook (xlsx) data source: ``spark.read.format("workbook")``.

One input partition per file; rows stream out of the sheet's XML, so a big sheet is never
held as a whole. Cells are text, a missing cell is null. With ``header=true`` (default)
the first row names the columns; without it columns are ``_c0``, ``_c1``, ...
Uses the standard library only.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column_index(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference).group(0):
        n = n * 26 + ord(ch) - 64
    return n - 1


def _number_text(raw: str) -> str:
    """Whole numbers without a decimal part, as a reader of typed cells would print them."""
    value = float(raw)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _first_sheet(names: list[str]) -> str:
    return min(
        (n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)),
        key=lambda n: int(re.search(r"(\d+)\.xml", n).group(1)),
    )


def read_rows(path: str | IO[bytes]) -> Iterator[list[str | None]]:
    """Rows of the first sheet of a file (path or open file)."""
    with zipfile.ZipFile(path) as book:
        names = book.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as f:
                for _, el in ElementTree.iterparse(f):
                    if el.tag == f"{_MAIN}si":
                        shared.append("".join(t.text or "" for t in el.iter(f"{_MAIN}t")))
                        el.clear()
        with book.open(_first_sheet(names)) as f:
            for _, el in ElementTree.iterparse(f):
                if el.tag != f"{_MAIN}row":
                    continue
                row: list[str | None] = []
                for cell in el.findall(f"{_MAIN}c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else len(row)
                    row.extend([None] * (at - len(row)))
                    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is None or value.text is None:
                        text = None
                    elif kind == "s":
                        text = shared[int(value.text)]
                    elif kind in (None, "n"):
                        text = _number_text(value.text)
                    else:
                        text = value.text
                    row.append(text)
                el.clear()
                yield row


def sheet_width(path: str) -> int:
    """Columns of the first sheet: from its dimension tag, else from its rows."""
    with zipfile.ZipFile(path) as book:
        sheet = _first_sheet(book.namelist())
        with book.open(sheet) as f:
            for event, el in ElementTree.iterparse(f, events=("start",)):
                if el.tag == f"{_MAIN}dimension":
                    return _column_index(el.get("ref").split(":")[-1]) + 1
                if el.tag == f"{_MAIN}row":
                    break
    return max((len(r) for r in read_rows(path)), default=0)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType, header: bool):
        self.paths, self.schema, self.header = paths, schema, header

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        wanted = [f.name for f in self.schema.fields if f.name not in ("_file", "_row")]
        file = partition.path.rsplit("/", 1)[-1]
        at: dict[str, int] = {}
        for n, row in enumerate(read_rows(partition.path)):
            if self.header and n == 0:
                at = {name: i for i, name in enumerate(row) if name is not None}
                continue
            if not at:
                at = {f"_c{i}": i for i in range(len(wanted))}
            cells = [row[at[w]] if w in at and at[w] < len(row) else None for w in wanted]
            yield (*cells, file, n)


class WorkbookSource(DataSource):
    """Options: ``path`` (file, folder or glob), ``header`` (true/false)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _paths(self) -> list[str]:
        import glob
        import os

        path = self.options["path"]
        if os.path.isdir(path):
            path = os.path.join(path, "*.xlsx")
        return sorted(glob.glob(path))

    def _header(self) -> bool:
        return self.options.get("header", "true").lower() == "true"

    def schema(self) -> StructType:
        """Column names in order of first appearance over all files, then file and row."""
        names: dict[str, None] = {}
        for p in self._paths():
            if self._header():
                first = next(read_rows(p), [])
                names.update(dict.fromkeys(c for c in first if c is not None))
            else:
                names.update(dict.fromkeys(f"_c{i}" for i in range(sheet_width(p))))
        fields = [StructField(n, StringType()) for n in names]
        return StructType([*fields, StructField("_file", StringType()), StructField("_row", LongType())])

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self._paths(), schema, self._header())
