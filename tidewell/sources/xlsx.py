"""Workbooks as rows: each file is parsed by one task, as a stream (the format bounds a sheet at 1,048,576 rows)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows handed on at a time.
ROWS = 5000


def texts_of(node: ElementTree.Element) -> str:
    """The text of a shared or inline string; phonetic hints don't count."""
    runs = [node, *node.findall(f"{MAIN}r")]
    return "".join(t.text or "" for run in runs for t in run.findall(f"{MAIN}t"))


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{MAIN}si":
                out.append(texts_of(node))
                node.clear()
    return out


def sheet_path(book: zipfile.ZipFile, sheet: str | None) -> str:
    """Where the named sheet lies (None: the first one)."""
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{MAIN}sheets/{MAIN}sheet")
    found = next((s for s in sheets if sheet is None or s.get("name") == sheet), None)
    if found is None:
        raise ValueError(f"no sheet {sheet!r}")
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[found.get(LINK)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def column_of(reference: str) -> int:
    """0 for A, 26 for AA."""
    at = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def cells_of(row: ElementTree.Element, strings: list[str]) -> dict[int, str]:
    """Column to text; empty and error cells are left out."""
    out: dict[int, str] = {}
    at = -1
    for cell in row.findall(f"{MAIN}c"):
        at = column_of(cell.get("r")) if cell.get("r") else at + 1
        kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            inline = cell.find(f"{MAIN}is")
            text = texts_of(inline) if inline is not None else ""
        elif value is None or kind == "e":
            continue
        else:
            text = strings[int(value.text)] if kind == "s" else {"0": "false", "1": "true"}[value.text] if kind == "b" else value.text or ""
        if text != "":
            out[at] = text
    return out


def records(data: bytes, sheet: str | None = None) -> Iterator[dict[str, str]]:
    """Header to text for each row below the first one that has a cell; rows without cells are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        strings, header = shared_strings(book), None
        with book.open(sheet_path(book, sheet)) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{MAIN}row":
                    continue
                cells = cells_of(node, strings)
                node.clear()
                if header is None and cells:
                    header = {k: v.strip() for k, v in cells.items()}
                elif cells:
                    found = {header[k]: v for k, v in cells.items() if k in header}
                    if found:
                        yield found


def read_xlsx(spark: SparkSession, where: str, columns: list[str], sheet: str | None = None) -> DataFrame:
    """The named columns of all workbooks at ``where`` as strings; a column that a file lacks is null, others are left out.

    Numbers and dates come as the file holds them (dates as day numbers).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                held = []
                for record in records(data, sheet):
                    row = [record.get(c) for c in columns]
                    if any(v is not None for v in row):
                        held.append(row)
                    if len(held) == ROWS:
                        yield pd.DataFrame(held, columns=columns, dtype=object)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns, dtype=object)

    files = spark.read.format("binaryFile").load(where).select("content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))
