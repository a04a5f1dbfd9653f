"""Reports from files: tables, documents and texts become one row a narrative.

Tabular text is read by Spark's own reader; workbooks and word-processor files are
zip archives of XML and are opened, one file a task at a time, by the standard
library. A file that fails becomes an error row; the others go on.
"""

from __future__ import annotations

import csv
import io
import time
import zipfile
from collections.abc import Iterator, Mapping
from datetime import date, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators import snapshot

MOST_BYTES, MOST_ROWS = 20 * 2**20, 10_000
FIELDS = ("vendor", "report_number", "report_date", "product", "batch", "asset_id")
SEGMENTS = "path string, segment int, kind string, cells map<string,string>, error string"


def files(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """(path, length, content, sha256) of all files below a folder, by suffix."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if suffixes:
        rows = rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*[s.lower().lstrip(".") for s in suffixes]))
    return rows.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of all files below a folder; large ones are read as a stream."""
    return snapshot.checksums(spark, path).select("path", "sha256")


def delimited(spark: SparkSession, path: str, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A table of strings; within quotes a doubled quote stands for itself. A row with too few or too many cells fails the read."""
    reader = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("escape", "\"").option("multiLine", True).option("mode", "FAILFAST").option("enforceSchema", False)
    return reader.csv(path)


def numbered(rows: DataFrame, name: str = "source_row") -> DataFrame:
    """Rows of delimited() with their number in their file, the first below the header being 2.

    Such a file is read by one task from its beginning, so the order of that task is the file's.
    """
    place = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    nth = F.row_number().over(Window.partitionBy("__file").orderBy("__at")) + 1
    return place.withColumn(name, nth).drop("__file", "__at")


def headers(spark: SparkSession, path: str, separator: str = ",", encoding: str = "UTF-8") -> list[str]:
    return delimited(spark, path, separator, encoding).columns


def texts(spark: SparkSession, path: str) -> DataFrame:
    """A file is one segment."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lit(0).alias("segment"), F.col("value").alias("narrative"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are no JSON of the schema fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


_NS = {"s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _dates(archive: zipfile.ZipFile) -> set[int]:
    """Cell styles that show dates."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iterfind(".//s:numFmts/s:numFmt", _NS)}
    is_date = lambda k: 14 <= k <= 22 or any(c in own.get(k, "").lower() for c in ("yy", "mm/", "dd"))
    return {i for i, x in enumerate(root.iterfind(".//s:cellXfs/s:xf", _NS)) if is_date(int(x.get("numFmtId", 0)))}


def workbook_rows(content: bytes) -> list[dict[str, str]]:
    """The active sheet below its header, values only; dates as ISO text, missing cells empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in x.iterfind(".//s:t", _NS)) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iterfind("s:si", _NS)]
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        view = book.find(".//s:bookViews/s:workbookView", _NS)
        sheet = book.findall(".//s:sheets/s:sheet", _NS)[int(view.get("activeTab", 0)) if view is not None else 0]
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        target = links[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
        root = ElementTree.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}"))
        styles = _dates(archive)
    table: list[dict[int, str]] = []
    for row in root.iterfind(".//s:sheetData/s:row", _NS):
        cells: dict[int, str] = {}
        for i, c in enumerate(row.iterfind("s:c", _NS)):
            at = _column(c.get("r")) if c.get("r") else i
            value, kind = c.findtext("s:v", None, _NS), c.get("t")
            if kind == "s":
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iterfind(".//s:t", _NS))
            elif kind is None and value and int(c.get("s", 0)) in styles:
                value = (date(1899, 12, 30) + timedelta(days=int(float(value)))).isoformat()
            cells[at] = value or ""
        table.append(cells)
    if not table:
        return []
    names = {i: v for i, v in table[0].items() if v}
    return [{name: row.get(i, "") for i, name in names.items()} for row in table[1:]]


def document_text(content: bytes) -> str:
    """Paragraphs and tables in their order; cells joined by ' | ', blocks by line feeds."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find("w:body", _NS)
    said = lambda x: "".join(t.text or "" for t in x.iterfind(".//w:t", _NS)).strip()
    blocks = []
    for block in body:
        tag = block.tag.rpartition("}")[2]
        if tag == "p":
            blocks.append(said(block))
        elif tag == "tbl":
            blocks += [" | ".join(said(c) for c in row.iterfind("w:tc", _NS)) for row in block.iterfind("w:tr", _NS)]
    return "\n".join(b for b in blocks if b)


def _pdf_pages(content: bytes) -> list[str]:
    try:
        import fitz  # optional plug-in
    except ImportError as e:
        raise RuntimeError("reading PDF needs an optional library that is not installed") from e
    with fitz.open(stream=content) as pdf:
        if pdf.needs_pass:
            raise ValueError("the PDF is protected by a password")
        pages = [page.get_text() for page in pdf]
    if any(not p.strip() for p in pages):
        raise ValueError("the PDF has a page without text")
    return pages


def table_rows(content: bytes, separator: str, encoding: str = "utf-8-sig") -> list[dict[str, str]]:
    """Rows of a delimited file below its header, whose names must be there once each; a ragged row is an error."""
    rows = list(csv.reader(io.StringIO(content.decode(encoding), newline=""), delimiter=separator, strict=True))
    if not rows or not any(rows[0]):
        raise ValueError("the table has no header")
    names = rows[0]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"the header names {twice} more than once")
    for i, row in enumerate(rows[1:], 2):
        if row and len(row) != len(names):
            raise ValueError(f"line {i} has {len(row)} cells instead of {len(names)}")
    return [dict(zip(names, row)) for row in rows[1:] if row]


def _segments(path: str, content: bytes) -> Iterator[tuple]:
    suffix = path.rpartition(".")[2].lower()
    if len(content) > MOST_BYTES:
        raise ValueError(f"the file is larger than {MOST_BYTES} bytes")
    if suffix in ("xlsx", "csv", "tsv"):
        rows = workbook_rows(content) if suffix == "xlsx" else table_rows(content, "," if suffix == "csv" else "\t")
        if len(rows) > MOST_ROWS:
            raise ValueError(f"the file has more than {MOST_ROWS} rows")
        yield from ((path, i, "row", row, None) for i, row in enumerate(rows))
    elif suffix == "docx":
        yield path, 0, "document", {"text": document_text(content)}, None
    elif suffix == "pdf":
        yield from ((path, i, "page", {"text": page}, None) for i, page in enumerate(_pdf_pages(content)))
    elif suffix == "txt":
        yield path, 0, "document", {"text": content.decode("utf-8-sig")}, None
    else:
        raise ValueError(f"files ending in .{suffix} are not supported")


def segments(found: DataFrame) -> DataFrame:
    """files() to (path, segment, kind, cells, error): a failing file is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += list(_segments(path, bytes(content)))
                except Exception as e:  # noqa: BLE001  whatever a file does to its reader is that file's error
                    rows.append((path, -1, "error", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "segment", "kind", "cells", "error"])

    return found.select("path", "content").mapInPandas(run, SEGMENTS)


def benchmark(found: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(path, kind, segments, seconds, error) of parsing each file once, where the files are; files that are not among reviewed (path) are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                began, n, error = time.perf_counter(), 0, None
                try:
                    n = sum(1 for _ in _segments(path, bytes(content)))
                except Exception as e:  # noqa: BLE001  whatever a file does to its reader is that file's error
                    error = str(e)
                rows.append((path, path.rpartition(".")[2].lower(), n, time.perf_counter() - began, error))
            yield pd.DataFrame(rows, columns=["path", "kind", "segments", "seconds", "error"])

    if not found.join(reviewed.select("path"), "path", "left_anti").isEmpty():
        raise ValueError("only files that were reviewed for privacy can be measured")
    return found.select("path", "content").mapInPandas(run, "path string, kind string, segments long, seconds double, error string")


def records(rows: DataFrame, text: str, metadata: Mapping[str, str] | None = None, given: Mapping[str, str] | None = None, date_format: str = "yyyy-M-d", aliases: dict[str, str] | None = None) -> DataFrame:
    """Table rows to canonical records: display_text with its lines, narrative on one line, and offsets from this to that.

    metadata maps fields to columns, given holds values for all rows; a row's own
    value wins. Only the narrative and mapped columns are kept. Blank narratives go,
    and their number is a flag of every record that stays.
    """
    metadata, given = metadata or {}, given or {}
    unknown = {*metadata, *given} - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown metadata fields: {sorted(unknown)}")
    for name in (text, *metadata.values()):
        if rows.columns.count(name) != 1:
            raise ValueError(f"the table needs the column {name} exactly once")
    blank_to_null = lambda c: T.blank_to_null(T.collapse(c))
    values = {f: F.coalesce(blank_to_null(F.col(f"`{metadata[f]}`")) if f in metadata else F.lit(None).cast("string"), F.lit(given.get(f)).cast("string")) for f in FIELDS}
    raw = values["report_date"]
    parsed = T.parse_date(raw, date_format)
    bad = raw.isNotNull() & parsed.isNull()
    values["report_date"] = F.when(bad, F.raise_error(F.lit("a report date is ambiguous or invalid; name its format"))).otherwise(parsed)
    evidence = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = rows.select(evidence.alias("raw"), *[c.alias(f) for f, c in values.items()], *[F.when(blank_to_null(F.col(f"`{metadata[f]}`")).isNotNull(), f"column:{metadata[f]}").otherwise("user").alias(f"__{f}") for f in metadata])
    empty = out.agg(F.count_if(F.trim("raw") == "").alias("empty"))
    clean = T.prepare_evidence(F.col("raw"))
    out = out.where(F.trim("raw") != "").crossJoin(F.broadcast(empty)).withColumn("c", clean)
    flags = F.array_compact(F.array(F.when(F.size(T.tokens(F.col("c.clean"))) < 4, "sparse_text"), F.when(F.col("empty") > 0, F.concat(F.lit("empty_rows:"), F.col("empty").cast("string")))))
    provenance = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in metadata]), F.array(*[F.col(f"__{f}") for f in metadata])), lambda k, v: v.isNotNull()) if metadata else F.expr("cast(map() as map<string,string>)")
    return out.select(
        F.col("c.clean").alias("narrative"), F.col("c.display").alias("display_text"), F.col("c.offsets").alias("clean_to_display"), F.col("c.sensitive").alias("sensitive"), flags.alias("quality_flags"), *FIELDS, T.vendor_key(F.col("vendor"), aliases).alias("vendor_key"), F.col("report_number").alias("report_id"), provenance.alias("provenance")
    )


# Columns of the research sources.
DIALECTS = {
    "fire_door": {"text": "English", "id": None, "date": None, "targets": ["Classification_English"]},
    "faa_sdr": {"text": "Discrepancy", "id": "OperatorControlNumber", "date": "DifficultyDate", "targets": ["PartCondition", "PartName", "ComponentName"]},
    "phmsa_legacy": {"text": "NARRATIVE", "id": "RPTID", "date": "IDATE", "targets": ["CAUSE", "CAUSE_TEXT", "CAUSE_DETAILS_TEXT"]},
    "phmsa": {"text": "NARRATIVE", "id": "REPORT_NUMBER", "date": "LOCAL_DATETIME", "targets": ["REPORT_TYPE", "CAUSE", "CAUSE_DETAILS", "SYSTEM_PART_INVOLVED", "MATERIAL_INVOLVED"]},
}


def dialect_of(path: str) -> str:
    stem = path.rpartition("/")[2].rpartition(".")[0].lower()
    if path.lower().endswith(".xlsx"):
        return "fire_door"
    if path.lower().endswith(".csv"):
        return "faa_sdr"
    return "phmsa_legacy" if "mar2004_dec2009" in stem else "phmsa"


def source_records(rows: DataFrame, dialect: str, path: str) -> DataFrame:
    """Rows of a source in one form; targets stay apart from the text, and only those that say something."""
    columns = DIALECTS[dialect]
    lacking = {columns["text"], *([columns["id"]] if columns["id"] else [])} - set(rows.columns)
    if lacking:
        raise ValueError(f"{path} lacks {sorted(lacking)}")
    stem = path.rpartition("/")[2].rpartition(".")[0]
    if columns["id"] is None and "source_row" not in rows.columns:
        raise ValueError(f"{path} names its records by row: number them first")
    rows = rows if "source_row" in rows.columns else rows.withColumn("source_row", F.lit(None).cast("int"))
    key: Column = F.col(columns["id"]) if columns["id"] else F.concat(F.lit(f"{stem}:"), F.col("source_row").cast("string"))
    targets = [c for c in columns["targets"] if c in rows.columns]
    said = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in targets]), F.array(*[F.coalesce(F.col(c), F.lit("")) for c in targets])), lambda k, v: F.trim(v) != "") if targets else F.expr("cast(map() as map<string,string>)")
    clean = T.prepare_evidence(F.coalesce(F.col(columns["text"]), F.lit("")))
    return rows.select(
        F.lit(dialect).alias("source_dataset"), F.when(T.blank_to_null(F.trim(key)).isNull(), F.raise_error(F.lit(f"{path}: a row has no id"))).otherwise(key).alias("source_record_id"), "source_row", clean.alias("c"),
        (F.col(columns["date"]) if columns["date"] and columns["date"] in rows.columns else F.lit(None).cast("string")).alias("report_date"), said.alias("structured"),
    ).select("source_dataset", "source_record_id", "source_row", F.col("c.clean").alias("narrative"), F.col("c.display").alias("display_text"), F.col("c.offsets").alias("clean_to_display"), F.col("c.sensitive").alias("sensitive"), "report_date", "structured", F.when(F.col("c.clean") == "", "empty_narrative").otherwise("").alias("excluded"))
