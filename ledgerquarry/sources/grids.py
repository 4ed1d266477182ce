"""Tables and texts of any format as rows of cells."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID_SCHEMA = "ref string, page int, row_no int, cells array<string>"
Rows = list[tuple[int, list[str]]]


def _trimmed(cells: list[str]) -> list[str]:
    while cells and not cells[-1].strip():
        cells = cells[:-1]
    return cells


def csv_rows(content: bytes) -> Rows:
    """The separator is the most frequent of comma, semicolon, tab and bar at the start; quoted line ends are kept."""
    text = content.decode("utf-8-sig", "replace")
    counts = Counter(c for c in text[:4096] if c in ",;\t|")
    separator = max(",;\t|", key=lambda c: counts[c])
    return [(1, _trimmed(r)) for r in csv.reader(io.StringIO(text, newline=""), delimiter=separator)]


def _column(cell_ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", cell_ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _number(text: str) -> str:
    try:
        x = float(text)
    except ValueError:
        return text
    two = f"{x:.2f}"
    return two if abs(x - float(two)) < 1e-9 and x != int(x) else f"{x:g}"


def xlsx_rows(content: bytes) -> Rows:
    """Every sheet's cached values; the sheet's number is the page."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter("{%s}t" % ns["m"])) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        out: Rows = []
        for page, sheet in enumerate(sheets, 1):
            for row in ET.fromstring(z.read(sheet)).iterfind(".//m:row", ns):
                cells: list[str] = []
                for c in row.iterfind("m:c", ns):
                    at = _column(c.get("r", "")) or len(cells) + 1
                    cells += [""] * (at - len(cells))
                    value = c.findtext("m:v", "", ns)
                    kind = c.get("t")
                    cells[at - 1] = shared[int(value)] if kind == "s" and value else "".join(t.text or "" for t in c.iter("{%s}t" % ns["m"])) if kind == "inlineStr" else _number(value) if kind in (None, "n") and value else value
                out.append((page, _trimmed(cells)))
        return out


def split_line(line: str) -> list[str]:
    return [c.strip() for c in re.split(r"\t+|\s{2,}", line.strip()) if c.strip()]


def docx_rows(content: bytes) -> Rows:
    """Paragraphs and tables in the order of the body; an empty row follows a table."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    text = lambda e: "".join("\t" if x.tag == w + "tab" else "\n" if x.tag == w + "br" else x.text or "" for x in e.iter() if x.tag in (w + "t", w + "tab", w + "br"))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(w + "body")
    out: Rows = []
    for e in body if body is not None else ():
        if e.tag == w + "p":
            out += [(1, split_line(x)) for x in text(e).split("\n")]
        elif e.tag == w + "tbl":
            for row in e.iter(w + "tr"):
                out.append((1, _trimmed([" ".join(text(p) for p in cell.iter(w + "p")).strip() for cell in row.iter(w + "tc")])))
            out.append((1, []))
    return out


READERS = {"csv": csv_rows, "xlsx": xlsx_rows, "docx": docx_rows, "text": lambda b: [(1, split_line(x)) for x in b.decode("utf-8", "replace").splitlines()]}


def _decoder(readers):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ref, kind, content in zip(pdf["ref"], pdf["kind"], pdf["content"]):
                try:
                    found = readers[kind](bytes(content))
                except Exception:  # unreadable: no rows; the item itself stays with its kind
                    found = []
                rows += [(ref, page, n, cells) for n, (page, cells) in enumerate(found)]
            if rows:
                yield pd.DataFrame(rows, columns=["ref", "page", "row_no", "cells"])

    return run


def grid_rows(items: DataFrame, readers: dict | None = None) -> DataFrame:
    """``GRID_SCHEMA`` of items (ref, kind, content) whose kind has a reader; row_no runs over all pages of an item.

    ``readers`` adds to ``READERS``, or replaces them: kind -> function from bytes to (page, cells) rows.
    """
    use = {**READERS, **(readers or {})}
    return items.where(F.col("kind").isin(*use)).select("ref", "kind", "content").mapInPandas(_decoder(use), GRID_SCHEMA)


def text_cells(docs: DataFrame, ref: str, text: str) -> DataFrame:
    """(ref, row_no, cells) of plain texts, in the JVM: lines, parted at tabs or two blanks."""
    lines = docs.select(F.col(ref), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\R")).alias("row_no", "line"))
    cells = F.filter(F.transform(F.split("line", r"\t+|\s{2,}"), F.trim), lambda x: x != "")
    return lines.select(ref, "row_no", cells.alias("cells"))
