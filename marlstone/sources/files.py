"""Files to text: a folder is read as binary rows; PDF (by a plug-in), DOCX and XLSX are parsed in Python workers, one file per row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length bigint, content binary"
PARSED = "path string, filename string, ext string, file_size_kb double, raw_text string, page_count int, error string"
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

Extractor = Callable[[bytes], tuple[str, int | None]]


def docx_text(content: bytes) -> tuple[str, int | None]:
    """Non-blank paragraphs, then the rows of all tables, a blank line between."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_NS}body")
    # fixed values: what stands for text besides text
    other = {f"{WORD_NS}tab": "\t", f"{WORD_NS}br": "\n", f"{WORD_NS}cr": "\n"}
    # runs only: tabs in a paragraph's properties are tab stops
    text = lambda node: "".join(
        t.text or "" if t.tag == f"{WORD_NS}t" else other.get(t.tag, "") for run in node.iter(f"{WORD_NS}r") for t in run)
    parts = [text(p).strip() for p in body.findall(f"{WORD_NS}p")]
    for row in body.iterfind(f"{WORD_NS}tbl/{WORD_NS}tr"):
        cells = [" ".join(text(p) for p in c.findall(f"{WORD_NS}p")).strip() for c in row.findall(f"{WORD_NS}tc")]
        parts.append(" | ".join(c for c in cells if c))
    return "\n\n".join(p for p in parts if p), None


# fixed values: numbers of built-in formats that show dates or times
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _date_styles(z: zipfile.ZipFile) -> list[bool]:
    """Per cell style, whether it shows a date."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for f in root.iter(f"{SHEET_NS}numFmt")}
    styles = root.find(f"{SHEET_NS}cellXfs")
    numbers = [int(x.get("numFmtId") or 0) for x in styles] if styles is not None else []
    return [n in DATE_FORMATS or bool(re.search("[ymdhs]", own.get(n, ""), re.IGNORECASE)) for n in numbers]


def _cell(kind: str | None, value: str, is_date: bool) -> str:
    """A stored value as it is printed: booleans as True and False, serial numbers of dates as dates."""
    if kind == "b":
        return "True" if value == "1" else "False"
    if is_date and kind in (None, "n"):
        day = datetime(1899, 12, 30) + timedelta(seconds=round(float(value) * 86400))
        return str(day.time()) if 0 <= float(value) < 1 else str(day)
    return value


def xlsx_text(content: bytes) -> tuple[str, int | None]:
    """Per sheet its name, then each row that has a value, with the row's number; stored values, not formulas."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{SHEET_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out, dates = [], _date_styles(z)
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET_NS}sheet"):
            out.append(f"[SHEET: {sheet.get('name')}]")
            target = targets[sheet.get(f"{REL_NS}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for n, row in enumerate(root.iter(f"{SHEET_NS}row"), 1):
                values = []
                for c in row.findall(f"{SHEET_NS}c"):
                    v, inline = c.find(f"{SHEET_NS}v"), c.find(f"{SHEET_NS}is")
                    if c.get("t") == "inlineStr" and inline is not None:
                        values.append("".join(t.text or "" for t in inline.iter(f"{SHEET_NS}t")))
                    elif v is not None and v.text is not None:
                        style = int(c.get("s") or 0)
                        values.append(strings[int(v.text)] if c.get("t") == "s" else _cell(c.get("t"), v.text, style < len(dates) and dates[style]))
                if values:
                    out.append(f"[ROW {row.get('r') or n}] " + " | ".join(values))
        return "\n".join(out), None


def pages_text(pages: list[str]) -> tuple[str, int]:
    """Tagged non-empty pages; empty ones count."""
    return "\n\n".join(f"[PAGE {n}]\n{p}" for n, p in enumerate(pages, 1) if p.strip()), len(pages)


def no_pdf(_: bytes) -> tuple[str, int | None]:
    raise ValueError("no PDF extractor is registered")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder)


def parse_files(files: DataFrame, pdf: Callable[[], Extractor] | None = None) -> DataFrame:
    """One row per file: its text and pages, or the error that it gave. The type is told by the extension in lower case; ``pdf`` makes an
    extractor, once per worker, that gives (text, pages) for a file's bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {".pdf": pdf() if pdf else no_pdf, ".docx": docx_text, ".xlsx": xlsx_text, ".xls": xlsx_text}
        for batch in batches:
            rows = []
            for path, size, content in zip(batch["path"], batch["length"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                ext = (re.search(r"\.[^./]+$", name) or [""])[0].lower()
                text = pages = error = None
                try:
                    if ext not in readers:
                        raise ValueError(f"unsupported file type: {ext or name}")
                    text, pages = readers[ext](bytes(content))
                except Exception as e:  # one bad file is a row, not a failed job
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, name, ext, round(size / 1024, 2), text, pages, error))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])
            yield frame.astype({"page_count": "Int32"})

    return files.select("path", "length", "content").mapInPandas(run, PARSED)


def read_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON records, the latest first; records that can't be read are left out."""
    rows = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt").orderBy(F.desc("ingested_at"))


def write_records(records: DataFrame, folder: str) -> None:
    records.write.mode("append").json(folder)


def open_vectors(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """The vector table; a condition on doc_type reads only the folders of the types that meet it."""
    rows = spark.read.parquet(folder)
    return rows if where is None else rows.where(where)


def append_vectors(chunks: DataFrame, folder: str) -> None:
    """The vector table, a folder per doc_type, so that a filter on it prunes."""
    chunks.write.mode("append").partitionBy("doc_type").parquet(folder)
