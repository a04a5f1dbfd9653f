"""Exports of extracted records: rows for CSV, JSON envelopes, HTML, blinded batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators.analytics import workflow

VERSION = 1


def _known(found: DataFrame, name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in found.columns else F.lit(default)


def csv_rows(found: DataFrame) -> DataFrame:
    """31 columns, one row an entity and one with blank evidence for a record without; findings joined by '; '.

    Columns that the records lack are blank; linked evidence and provenance are JSON.
    """
    hit = lambda f, e: F.exists(F.concat(F.array(f["defect"]), f["links"]), lambda x: (x["label"] == e["label"]) & (x["start"] == e["start"]) & (x["stop"] == e["stop"]))
    flags = F.array_join(F.coalesce("quality_flags", F.expr("cast(array() as array<string>)")), "; ") if "quality_flags" in found.columns else F.lit("")
    provenance = F.to_json(F.coalesce("provenance", F.expr("cast(map() as map<string,string>)"))) if "provenance" in found.columns else F.lit("{}")
    metadata = ("source_document", "vendor", "report_number", "report_date", "product", "batch", "asset_id")
    versions = {"run_id": "", "review_version": "", "extractor_version": "", "score_kind": "uncalibrated"}
    rows = found.select(
        "record_id", "domain", "mapping_status", F.coalesce(T.blank_to_null(F.col("report_id")), F.col("record_id")).alias("report_id"), *[_known(found, c).alias(c) for c in metadata], workflow().alias("workflow"),
        *[_known(found, c, d).alias(c) for c, d in versions.items()], flags.alias("quality_flags"), provenance.alias("metadata_provenance"), "findings", F.explode_outer("entities").alias("e"),
    )
    rows = rows.withColumn("hits", F.array_sort(F.filter("findings", lambda f: hit(f, F.col("e")))))

    def told(of) -> Column:
        return F.array_join(F.transform("hits", of), "; ")

    def by_label(f: Column) -> Column:
        item = lambda e: F.struct(*[e[c].alias(c) for c in ("text", "start", "stop", "assertion", "confidence", "method")])
        labels = F.array_sort(F.array_distinct(F.transform(f["links"], lambda e: e["label"])))
        return F.map_from_entries(F.transform(labels, lambda x: F.struct(x.alias("key"), F.transform(F.filter(f["links"], lambda e: e["label"] == x), item).alias("value"))))

    linked = F.to_json(F.map_from_entries(F.transform("hits", lambda f: F.struct(f["finding_id"].alias("key"), by_label(f).alias("value")))))
    return rows.select(
        "record_id", "domain", "mapping_status", *[F.col(f"e.{c}").alias(n) for n, c in (("label", "label"), ("text", "text"), ("assertion", "assertion"), ("start", "start"), ("end", "stop"), ("confidence", "confidence"), ("method", "method"))],
        "report_id", *metadata, "workflow", *versions,
        told(lambda f: f["finding_id"]).alias("finding_ids"), told(lambda f: F.coalesce(f["category"], F.lit("Uncategorized"))).alias("categories"), told(lambda f: f["tier"]).alias("priorities"),
        told(lambda f: F.array_join(f["reasons"], "; ")).alias("priority_reasons"), linked.alias("linked_evidence"), "metadata_provenance", "quality_flags", F.lit(str(VERSION)).alias("export_schema_version"),
    )


def write_csv(found: DataFrame, path: str) -> None:
    """Cells that a spreadsheet would run are neutralised; an existing path is refused."""
    rows = csv_rows(found)
    rows.select(*[T.spreadsheet_safe(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in rows.columns]).write.mode("errorifexists").option("header", True).csv(path)


def write_json(found: DataFrame, path: str, form: str = "lines") -> None:
    """Nested records at a new path. lines: a folder with a line a record; list and envelope: one file, a list of records or
    {export_schema_version, records}, into which records pass one by one in order of their id."""
    if form == "lines":
        found.write.mode("errorifexists").json(path)
        return
    if form not in ("list", "envelope"):
        raise ValueError(f"unknown form {form}")
    rows = found.orderBy("record_id").select(F.to_json(F.struct(*found.columns), {"ignoreNullFields": "false"}).alias("x"))
    head, foot = ("[", "]") if form == "list" else (f'{{"export_schema_version": "{VERSION}", "records": [', "]}")
    _write_file(rows, path, head, foot, ",\n")


def _write_file(rows: DataFrame, path: str, head: str, foot: str, between: str = "\n") -> None:
    """One file of the rows' column x in their order; a partition at a time passes through the driver, so any number fits."""
    spark = rows.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, False)
    try:
        out.write(bytearray(head.encode()))
        for i, r in enumerate(rows.toLocalIterator()):
            out.write(bytearray(((between if i else "") + r["x"]).encode()))
        out.write(bytearray(foot.encode()))
    finally:
        out.close()


def highlight(text: Column, entities: Column) -> Column:
    """The text as HTML, escaped, with each span marked."""

    def step(known: Column, e: Column) -> Column:
        gap = T.escape_html(F.substring(text, known["at"] + 1, e["start"] - known["at"]))
        mark = F.concat(F.lit('<mark title="'), e["label"], F.lit(" · "), e["assertion"], F.lit('">'), T.escape_html(e["text"]), F.lit("</mark>"))
        return F.struct(F.concat(known["html"], gap, mark).alias("html"), e["stop"].alias("at"))

    return F.aggregate(entities, F.expr("struct('' as html, 0 as at)"), step, lambda k: F.concat(k["html"], T.escape_html(F.substring(text, k["at"] + 1, F.length(text)))))


def relationship_rows(found: DataFrame) -> DataFrame:
    rows = T.unfold(found, "findings", "f").select("f.finding_id", F.explode("f.links").alias("e"))
    return rows.select("finding_id", *[F.col(f"e.{c}").alias(c) for c in ("label", "start", "stop", "text")])


def blinded(records: DataFrame, approved: DataFrame, key: str, keep: Sequence[str] = ("record_id", "narrative")) -> DataFrame:
    """Approved records without predictions or metadata."""
    return records.join(approved.select(key).distinct(), key, "left_semi").select(*keep)


def html_sections(found: DataFrame) -> DataFrame:
    """(record_id, html): a section a record with its metadata, findings, marked text and quality flags, all escaped."""
    esc = T.escape_html
    cell = lambda c: F.concat(F.lit("<td>"), esc(c), F.lit("</td>"))
    links = lambda f: F.array_join(F.transform(f["links"], lambda e: F.concat_ws(": ", e["label"], e["text"])), "; ")
    cells = lambda f: (f["defect"]["text"], F.coalesce(f["category"], F.lit("Uncategorized")), f["defect"]["assertion"], f["tier"], F.array_join(f["reasons"], "; "), links(f))
    table = F.array_join(F.transform("findings", lambda f: F.concat(F.lit("<tr>"), *[cell(c) for c in cells(f)], F.lit("</tr>"))), "")
    names = ("vendor", "report_number", "report_date", "product", "batch", "asset_id")
    metadata = F.concat_ws("; ", *[F.when(_known(found, n) != "", F.concat_ws(": ", F.lit(n), _known(found, n))) for n in names])
    flags = F.array_join(F.coalesce("quality_flags", F.expr("cast(array() as array<string>)")), ", ") if "quality_flags" in found.columns else F.lit("")
    head = F.lit("</p><table><thead><tr><th>Defect</th><th>Category</th><th>Assertion</th><th>Priority</th><th>Reasons</th><th>Linked evidence</th></tr></thead><tbody>")
    return found.select("record_id", F.concat(
        F.lit("<section><h2>"), esc(F.col("record_id")), F.lit("</h2><p>"), esc(metadata), head, table, F.lit('</tbody></table><div class="evidence">'), highlight(F.col("narrative"), F.col("entities")),
        F.lit("</div><p>Quality flags: "), esc(F.when(flags == "", "None").otherwise(flags)), F.lit("</p></section>"),
    ).alias("html"))


def write_html(found: DataFrame, summary: DataFrame, rates: DataFrame, path: str) -> None:
    """A standalone page at a new path: one row of summary, vendor rates, and a section for every record in order of their id."""
    esc = T.escape_html
    cells = lambda df: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), esc(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns], F.lit("</tr>"))
    names = lambda df: "<tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"
    head = "<!doctype html><html lang=en><meta charset=utf-8><title>Findings</title><body>"
    summary_, rates_ = summary.select(cells(summary).alias("x")), rates.orderBy("vendor").select(cells(rates).alias("x"))
    tables = "".join(f"<table>{names(df)}{''.join(r['x'] for r in rows.toLocalIterator())}</table>" for df, rows in ((summary, summary_), (rates, rates_)))
    _write_file(html_sections(found).orderBy("record_id").select(F.col("html").alias("x")), path, head + tables, f"<footer>{VERSION}</footer></body></html>")
