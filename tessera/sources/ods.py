"""Spreadsheets (ODS): a reader over Spark's binary files and a data source that writes one sheet for each partition."""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from itertools import chain
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import XMLGenerator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# Names of the format.
OFFICE = "urn:oasis:names:tc:opendocument:xmlns:office:1.0"
TABLE = "urn:oasis:names:tc:opendocument:xmlns:table:1.0"
TEXT = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
MANIFEST = "urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"
XLINK = "http://www.w3.org/1999/xlink"
MIME = "application/vnd.oasis.opendocument.spreadsheet"
#: Rows that pass from the parser to Spark at once.
CHUNK = 10_000


@dataclass
class Run:
    """A stretch of equal rows: where it starts, how many they are, and their filled stretches of cells as (first column, columns, text)."""

    row: int
    rows: int
    cells: list[tuple[int, int, str]]


class _Sheet:
    """Follows the parser's events through one sheet. Only what is filled is kept, so padding costs nothing, however often it repeats."""

    def __init__(self, name: str | None):
        self.name, self.state = name, "before"
        self.row = self.column = self.silent = 0
        self.cells: list[tuple[int, int, str]] = []
        self.lines: list[str] = []

    def start(self, tag: str, node) -> None:
        if tag == f"{{{TABLE}}}table" and self.state == "before" and self.name in (None, node.get(f"{{{TABLE}}}name")):
            self.state = "inside"
        elif tag == f"{{{OFFICE}}}annotation":
            self.silent += 1
        elif tag == f"{{{TABLE}}}table-row":
            self.column, self.cells = 0, []
        elif tag in (f"{{{TABLE}}}table-cell", f"{{{TABLE}}}covered-table-cell"):
            self.lines = []

    def end(self, tag: str, node) -> Run | None:
        many = lambda what: int(node.get(f"{{{TABLE}}}number-{what}-repeated") or 1)
        if tag == f"{{{OFFICE}}}annotation":
            self.silent -= 1
        elif tag == f"{{{TEXT}}}p" and not self.silent:
            self.lines.append(spoken(node))
        elif tag in (f"{{{TABLE}}}table-cell", f"{{{TABLE}}}covered-table-cell"):
            if any(self.lines):
                self.cells.append((self.column, many("columns"), "\n".join(self.lines)))
            self.column += many("columns")
        elif tag == f"{{{TABLE}}}table-row":
            run = Run(self.row, many("rows"), self.cells)
            self.row += run.rows
            return run if run.cells else None
        elif tag == f"{{{TABLE}}}table" and self.state == "inside":
            self.state = "after"
        return None


def spoken(paragraph) -> str:
    """The text of a paragraph; the format has elements of its own for spaces, tabs and line ends."""
    own = {f"{{{TEXT}}}s": " ", f"{{{TEXT}}}tab": "\t", f"{{{TEXT}}}line-break": "\n"}
    parts = [paragraph.text or ""]
    for node in paragraph:
        parts.append(own[node.tag] * int(node.get(f"{{{TEXT}}}c") or 1) if node.tag in own else spoken(node))
        parts.append(node.tail or "")
    return "".join(parts)


def filled_runs(content: bytes, sheet: str | None = None) -> Iterator[Run]:
    """The filled rows of a sheet (the first by default), read as a stream."""
    at = _Sheet(sheet)
    with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("content.xml") as xml:
        for event, node in ElementTree.iterparse(xml, events=("start", "end")):
            if event == "start":
                at.start(node.tag, node)
            elif at.state == "inside":
                run = at.end(node.tag, node)
                if node.tag == f"{{{TABLE}}}table-row":
                    node.clear()
                if run:
                    yield run
            if at.state == "after":
                return
    if at.state == "before":
        raise ValueError(f"no sheet {sheet!r}")


def texts_at(run: Run, columns: list[int]) -> list[str]:
    """The texts of a run's row in the given columns; empty where nothing is filled."""
    return [next((text for first, n, text in run.cells if first <= c < first + n), "") for c in columns]


def read_ods(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None) -> DataFrame:
    """The given columns as texts, for every row that holds any value; each file's first filled row is its header and must hold the columns. A task parses whole files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for content in (c for frame in frames for c in frame["content"]):
            runs = filled_runs(content, sheet)
            names: dict[str, int] = {}
            for first, n, text in getattr(next(runs, None), "cells", []):
                names.setdefault(text, first)
            lost = [c for c in columns if c not in names]
            if lost:
                raise ValueError(f"missing columns: {', '.join(lost)}")
            at, held = [names[c] for c in columns], []
            for r in runs:
                row, left = texts_at(r, at), r.rows
                while left:
                    some = min(left, CHUNK - len(held))
                    held += [row] * some
                    left -= some
                    if len(held) == CHUNK:
                        yield pd.DataFrame(held, columns=columns, dtype=str)
                        held = []
            yield pd.DataFrame(held, columns=columns, dtype=str)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


#: How a value of each type is typed in a sheet: its kind, the attribute that holds it, and its text there. Other types are texts.
KINDS: dict[type, tuple[str, str, Callable[[Any], str]]] = {
    bool: ("boolean", "boolean-value", lambda v: "true" if v else "false"),
    int: ("float", "value", str),
    float: ("float", "value", repr),
    Decimal: ("float", "value", str),
    datetime: ("date", "date-value", lambda v: v.replace(tzinfo=None).isoformat()),
    date: ("date", "date-value", date.isoformat),
}
_link = re.compile(r"https?://\S+")
#: Characters that a sheet's name can't hold.
_unnamed = re.compile(r"[\[\]*?:/\\']")


class _Events:
    """A document written as XML events into an open file, so that no more than a row is held."""

    def __init__(self, out, names: dict[str, str]):
        self.xml = XMLGenerator(out, "UTF-8", short_empty_elements=True)
        self.given = {f"xmlns:{prefix}": uri for prefix, uri in names.items()}
        self.xml.startDocument()

    @contextmanager
    def inside(self, tag: str, **attributes: str):
        """An element around what is written meanwhile. Attributes are named ``prefix_name``."""
        said = {k.replace("_", ":", 1): v for k, v in attributes.items()}
        self.xml.startElement(tag, self.given | said)
        self.given = {}
        yield
        self.xml.endElement(tag)

    def paragraph(self, text: str) -> None:
        with self.inside("text:p"):
            if _link.fullmatch(text):
                with self.inside("text:a", xlink_type="simple", xlink_href=text):
                    self.xml.characters(text)
            else:
                self.xml.characters(text)

    def cell(self, value) -> None:
        kind = next((KINDS[t] for t in type(value).__mro__ if t in KINDS), None)
        if value is None:
            typed, lines = {}, []
        elif kind:
            shown = kind[2](value)
            typed, lines = {"office_value-type": kind[0], f"office_{kind[1]}": shown}, [shown]
        else:
            typed, lines = {"office_value-type": "string"}, str(value).split("\n")
        with self.inside("table:table-cell", **typed):
            for line in lines:
                self.paragraph(line)


def write_sheet(out, columns: list[str], rows: Iterable, sheet: str) -> None:
    """One sheet with a row of names and the rows, as a spreadsheet file into the open binary file ``out``; rows pass one by one."""
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), MIME)  # first and as it is, so that the file's kind can be read off it
        with z.open(zipfile.ZipInfo("META-INF/manifest.xml"), "w") as f:
            m = _Events(f, {"manifest": MANIFEST})
            with m.inside("manifest:manifest", manifest_version="1.2"):
                for path, kind in (("/", MIME), ("content.xml", "text/xml")):
                    with m.inside("manifest:file-entry", **{"manifest_full-path": path, "manifest_media-type": kind}):
                        pass
        entry = zipfile.ZipInfo("content.xml")
        entry.compress_type = zipfile.ZIP_DEFLATED
        with z.open(entry, "w", force_zip64=True) as f:
            e = _Events(f, {"office": OFFICE, "table": TABLE, "text": TEXT, "xlink": XLINK})
            with e.inside("office:document-content", office_version="1.2"), e.inside("office:body"), e.inside("office:spreadsheet"), e.inside("table:table", table_name=_unnamed.sub("_", sheet)[:31] or "rows"):
                for row in chain([columns], rows):
                    with e.inside("table:table-row"):
                        for value in row:
                            e.cell(value)


def build(columns: list[str], rows: Iterable, sheet: str) -> bytes:
    """``write_sheet`` in memory."""
    out = io.BytesIO()
    write_sheet(out, columns, rows, sheet)
    return out.getvalue()


def _store(path: str):
    """(file system, path in it): a local folder, or any store that Arrow reaches by URI (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Done(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    """Tasks write to a folder of this job's own; only a commit moves its files in (and replaced ones out), an abort deletes it."""

    def __init__(self, columns: list[str], path: str, sheet: str, overwrite: bool):
        self.columns, self.path, self.sheet, self.overwrite = columns, path, sheet, overwrite
        self.job = uuid.uuid4().hex

    def write(self, rows) -> _Done:
        from pyspark import TaskContext

        store, path = _store(self.path)
        store.create_dir(f"{path}/_temporary-{self.job}", recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job[:8]}-{task.taskAttemptId()}.ods"
        with store.open_output_stream(f"{path}/_temporary-{self.job}/{name}") as f:
            write_sheet(f, self.columns, rows, self.sheet)
        return _Done(name)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, path = _store(self.path)
        before = [f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.extension == "ods"] if self.overwrite else []
        for done in messages:
            if done is not None:
                store.move(f"{path}/_temporary-{self.job}/{done.name}", f"{path}/{done.name}")
        for old in before:
            store.delete_file(old)
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, path = _store(self.path)
        own = posixpath.join(path, f"_temporary-{self.job}")
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)


class OdsSource(DataSource):
    """``df.write.format("ods").option("path", shared folder or URI).mode("append" or "overwrite").save()``: a file for each partition; repartition reports first."""

    @classmethod
    def name(cls) -> str:
        return "ods"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(schema.fieldNames(), self.options["path"], self.options.get("sheet", "Sheet1"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OdsSource)
