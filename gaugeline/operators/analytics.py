"""Relational analytics over extracted records and finding rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.text import blank_to_null, let, unfold, vendor_key

FINDING_FIELDS = ("component", "material", "severity")
_LABEL = {"component": "COMPONENT", "material": "MATERIAL", "severity": "REPORTED_SEVERITY"}


def report_key() -> Column:
    return F.coalesce(blank_to_null(F.col("report_id")), F.col("record_id"))


def workflow() -> Column:
    return F.coalesce(blank_to_null(F.col("report_status")), F.lit("pending"))


def scope(records: DataFrame, vendor: Sequence[str] = (), domain: Sequence[str] = (), status: Sequence[str] = (), since: str | None = None, until: str | None = None) -> DataFrame:
    """Records within the metadata scope; an empty list does not filter, a date bound drops undated records."""
    for values, column in ((vendor, F.coalesce("vendor", F.lit("Unknown"))), (domain, F.col("domain")), (status, workflow())):
        if values:
            records = records.where(column.isin(*values))
    date = blank_to_null(F.col("report_date"))
    if since or until:
        records = records.where(date.isNotNull())
    if since:
        records = records.where(date >= since)
    return records.where(date <= until) if until else records


def with_shown(found: DataFrame) -> DataFrame:
    """found with shown, what finding_rows() shows of each finding and depends on its text alone: once_a_text() has it made once a text."""

    def field(f: Column, name: str) -> Column:
        texts = F.transform(F.filter(f["links"], lambda e: e["label"] == _LABEL[name]), lambda e: F.lower(e["text"]))
        return let(texts, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("Unknown")))).alias(name)

    def row(f: Column) -> Column:
        return F.struct(
            f["defect"]["start"].alias("start"), F.coalesce(f["category"], F.concat(F.lit("Uncategorized: "), F.lower(f["defect"]["text"]))).alias("defect"), f["defect"]["text"].alias("evidence"),
            f["defect"]["assertion"].alias("assertion"), f["tier"].alias("priority"), F.array_join(f["reasons"], "; ").alias("reasons"), f["ambiguous"].alias("ambiguous"), *[field(f, x) for x in FINDING_FIELDS],
        )

    return found.withColumn("shown", F.transform("findings", row))


def finding_rows(found: DataFrame, component: Sequence[str] = (), material: Sequence[str] = (), defect: Sequence[str] = (), assertion: Sequence[str] = ()) -> DataFrame:
    """One row a finding, with linked evidence as arrays; filters are IN lists and array overlaps."""
    if "shown" not in found.columns:
        found = with_shown(found)
    rows = unfold(found, "shown", "f", "record_id", report_key().alias("report_id"), F.coalesce("vendor", F.lit("Unknown")).alias("vendor"), "domain", blank_to_null(F.col("report_date")).alias("date"), workflow().alias("workflow"))
    for values, column in ((component, "f.component"), (material, "f.material")):
        if values:
            rows = rows.where(F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])))
    for values, column in ((defect, "f.defect"), (assertion, "f.assertion")):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return rows.select(
        F.concat_ws(":defect:", "record_id", F.col("f.start").cast("string")).alias("finding_id"), "record_id", "report_id", "vendor", "domain", "date",
        *[F.col(f"f.{c}") for c in ("defect", "evidence", "assertion", "priority", "reasons")], "workflow", F.col("f.ambiguous"), *[F.col(f"f.{x}") for x in FINDING_FIELDS],
    )


def active(rows: DataFrame) -> DataFrame:
    return rows.where("assertion = 'present'")


def entity_counts(found: DataFrame) -> DataFrame:
    return unfold(found, "entities.label", "entity").groupBy("entity").agg(F.count("*").alias("count"))


def review_summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("records"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("entities"),
        F.count_if(F.col("mapping_status") == "review_required").alias("review_required"), F.count_if(F.col("mapping_status") == "unmapped").alias("unmapped"),
    )


def overview(records: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: two aggregates side by side, each one row."""
    left = records.agg(
        F.count_distinct(report_key()).alias("reports"), F.count("*").alias("narratives"), F.count_distinct(F.when(workflow() != "reviewed", report_key())).alias("pending_reports")
    )
    right = active(rows).agg(F.count("*").alias("active_defects"), F.count_distinct("report_id").alias("affected_reports"))
    return left.join(F.broadcast(right), F.lit(True))


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.bround(F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(0.0), digits)


def vendor_rates(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Inspected and affected reports by vendor; the denominator ignores finding filters."""
    whole = records.groupBy(F.coalesce("vendor", F.lit("Unknown")).alias("vendor")).agg(F.count_distinct(report_key()).alias("inspected_reports"))
    part = active(rows).groupBy("vendor").agg(F.count_distinct("report_id").alias("affected_reports"))
    return whole.join(part, "vendor", "left").select(
        "vendor", "inspected_reports", F.coalesce("affected_reports", F.lit(0)).alias("affected_reports"),
        rate(F.coalesce("affected_reports", F.lit(0)), F.col("inspected_reports")).alias("affected_report_rate"),
    )


def monthly_trends(records: DataFrame, rows: DataFrame) -> DataFrame:
    month = F.substring("date", 1, 7).alias("month")
    whole = records.where(blank_to_null(F.col("report_date")).isNotNull()).groupBy(F.substring("report_date", 1, 7).alias("month")).agg(F.count_distinct(report_key()).alias("inspected_reports"))
    part = active(rows).where("date is not null").groupBy(month).agg(F.count_distinct("report_id").alias("affected_reports"), F.count("*").alias("active_defects"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return whole.join(part, "month", "left").select(
        "month", "inspected_reports", zero("affected_reports").alias("affected_reports"), zero("active_defects").alias("active_defects"),
        rate(zero("affected_reports"), F.col("inspected_reports")).alias("affected_report_rate"),
    )


def _present(found: DataFrame, chosen) -> Column:
    """How many findings of a record are present and chosen."""
    return F.size(F.filter("findings", lambda f: (f["defect"]["assertion"] == "present") & (chosen(f) if chosen else F.lit(True))))


def _by_report(found: DataFrame, group: Column, name: str, chosen) -> DataFrame:
    """(name, inspected_reports, affected_reports, active_defects): records are summed by report, then reports by group, so each record is read once."""
    rows = found.select(group.alias(name), report_key().alias("report_id"), _present(found, chosen).alias("active"))
    reports = rows.groupBy(name, "report_id").agg(F.sum("active").alias("active"))
    return reports.groupBy(name).agg(F.count("*").alias("inspected_reports"), F.count_if(F.col("active") > 0).alias("affected_reports"), F.sum("active").alias("active_defects"))


def vendor_rates_of(found: DataFrame, chosen=None) -> DataFrame:
    """vendor_rates() of extracted records in one pass; chosen filters findings (a struct to a condition), never the denominator."""
    rates = _by_report(found, F.coalesce("vendor", F.lit("Unknown")), "vendor", chosen)
    return rates.select("vendor", "inspected_reports", "affected_reports", rate(F.col("affected_reports"), F.col("inspected_reports")).alias("affected_report_rate"))


def monthly_trends_of(found: DataFrame, chosen=None) -> DataFrame:
    """monthly_trends() of extracted records in one pass."""
    dated = found.where(blank_to_null(F.col("report_date")).isNotNull())
    return _by_report(dated, F.substring("report_date", 1, 7), "month", chosen).withColumn("affected_report_rate", rate(F.col("affected_reports"), F.col("inspected_reports")))


def undated_reports(records: DataFrame) -> DataFrame:
    return records.where(blank_to_null(F.col("report_date")).isNull()).agg(F.count_distinct(report_key()).alias("undated_reports"))


def heatmap(rows: DataFrame, field: str) -> DataFrame:
    """Distinct findings by value of a field and defect."""
    value = F.explode(field) if field in FINDING_FIELDS else F.col(field)
    return rows.select(value.alias("group"), "defect", "finding_id").groupBy("group", "defect").agg(F.count_distinct("finding_id").alias("count"))


def cooccurrence(found: DataFrame, label: str) -> DataFrame:
    """Reports in which a value of a label and a defect both occur, under any assertion.

    A report's values and defects are gathered as sets, which the lexicon bounds, and paired there.
    """
    values = F.transform(F.filter("entities", lambda e: e["label"] == label), lambda e: F.lower(e["text"]))
    defects = F.col("shown.defect") if "shown" in found.columns else F.transform("findings", lambda f: F.coalesce(f["category"], F.concat(F.lit("Uncategorized: "), F.lower(f["defect"]["text"]))))
    rows = found.select(report_key().alias("report_id"), values.alias("values"), defects.alias("defects"))
    said = rows.select("report_id", F.explode(F.concat(F.transform("values", lambda v: F.struct(F.lit(0).alias("kind"), v.alias("said"))), F.transform("defects", lambda v: F.struct(F.lit(1).alias("kind"), v.alias("said"))))).alias("x"))
    sides = said.groupBy("report_id").agg(*[F.collect_set(F.when(F.col("x.kind") == k, F.col("x.said"))).alias(n) for k, n in ((0, "groups"), (1, "defects"))])
    pairs = sides.select(F.explode("groups").alias("group"), "defects").select("group", F.explode("defects").alias("defect"))
    return pairs.groupBy("group", "defect").agg(F.count("*").alias("count"))


def severity_distribution(rows: DataFrame, order: Sequence[str] = ("critical", "severe", "major", "minor", "Unknown")) -> DataFrame:
    known = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    return active(rows).select(F.explode("severity").alias("severity")).groupBy("severity").agg(F.count("*").alias("count")).withColumn("position", F.coalesce(known[F.col("severity")], F.lit(len(order))))


def pareto(rows: DataFrame) -> DataFrame:
    """Defects by frequency with running totals; the window runs over one row a defect."""
    counted = active(rows).groupBy("defect").agg(F.count("*").alias("count"))
    order = Window.orderBy(F.desc("count"), "defect")
    return counted.select(
        "defect", "count", F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"),
        F.bround(F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0)) * 100.0 / F.sum("count").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 4).alias("cumulative_percent"),
    )


def age_days(created: Column, now: Column) -> Column:
    """Days of 86,400 s between two times, each cut to its second; 0 for a future or unknown one."""
    return F.greatest(F.coalesce(F.timestamp_diff("DAY", F.date_trunc("second", created), F.date_trunc("second", now)), F.lit(0)), F.lit(0))


def review_queue(found: DataFrame, rows: DataFrame, quality: Column | None = None) -> DataFrame:
    """What is open: findings, unsupported clauses, and records with quality flags only."""
    waiting = found.where(workflow() != "reviewed")
    base = [F.col("record_id"), report_key().alias("report_id"), F.coalesce("vendor", F.lit("Unknown")).alias("vendor"), workflow().alias("workflow")]
    level = F.when(F.col("review_priority").isNotNull(), "normal").otherwise("disabled").alias("priority")
    one = rows.where("workflow <> 'reviewed'").select("record_id", "report_id", "vendor", "workflow", "priority", "evidence", "reasons")
    two = unfold(waiting, "review_candidates", "c", *base, level).select("record_id", "report_id", "vendor", "workflow", "priority", F.col("c.text").alias("evidence"), F.lit("Inspection or action clause without a supported defect").alias("reasons"))
    out = one.unionByName(two)
    if quality is not None:
        bare = waiting.where((F.size("findings") == 0) & (F.size("review_candidates") == 0)).select(*base, level, quality.alias("reasons"))
        out = out.unionByName(bare.where("reasons <> ''").withColumn("evidence", F.lit("Extraction quality review")))
    return out


def review_queue_of(found: DataFrame, quality: Column | None = None) -> DataFrame:
    """review_queue() of extracted records with all their findings, in one pass: a record's entries are made beside each other."""
    if "shown" not in found.columns:
        found = with_shown(found)
    level = F.when(F.col("review_priority").isNotNull(), "normal").otherwise("disabled")
    entry = lambda priority, evidence, reasons: F.struct(priority.alias("priority"), evidence.alias("evidence"), reasons.alias("reasons"))
    none = F.expr("cast(array() as array<struct<priority:string,evidence:string,reasons:string>>)")
    one = F.transform("shown", lambda f: entry(f["priority"], f["evidence"], f["reasons"]))
    two = F.transform("review_candidates", lambda c: entry(level, c["text"], F.lit("Inspection or action clause without a supported defect")))
    entries = [F.coalesce(one, none), F.coalesce(two, none)]
    if quality is not None:
        bare = (F.size("shown") == 0) & (F.size("review_candidates") == 0) & (quality != "")
        entries.append(F.when(bare, F.array(entry(level, F.lit("Extraction quality review"), quality))).otherwise(none))
    base = [F.col("record_id"), report_key().alias("report_id"), F.coalesce("vendor", F.lit("Unknown")).alias("vendor"), workflow().alias("workflow")]
    rows = unfold(found.where(workflow() != "reviewed"), F.concat(*entries), "e", *base)
    return rows.select("record_id", "report_id", "vendor", "workflow", "e.priority", "e.evidence", "e.reasons")


def queued(found: DataFrame, quality: Column | None = None) -> DataFrame:
    """The records that have an entry in review_queue_of(); each says so itself. Unfolded, since a filter would go below the extraction and compute it again."""
    n, m = F.size("shown" if "shown" in found.columns else "findings"), F.size("review_candidates")
    some = (n > 0) | (m > 0)
    if quality is not None:
        some = some | ((n == 0) & (m == 0) & (quality != ""))
    return unfold(found.where(workflow() != "reviewed"), F.when(some, F.array(F.lit(True))), "_in", *found.columns).drop("_in")


def priority_order() -> Column:
    return F.when(F.col("priority") == "high", 0).when(F.col("priority") == "normal", 1).when(F.col("priority") == "low", 2).otherwise(3)


def _linkage() -> dict[str, Column]:
    """What ties a finding to earlier ones: vendor, asset or else batch, and date; a missing part is null."""
    asset, batch = blank_to_null(F.col("asset_id")), blank_to_null(F.col("batch"))
    kind = F.when(asset.isNotNull(), "asset").when(batch.isNotNull(), "batch")
    return {"vendor": blank_to_null(vendor_key(F.col("vendor"))), "kind": kind, "thing": F.coalesce(asset, batch), "date": blank_to_null(F.col("report_date"))}


def recurrence_status() -> Column:
    """Whether a record can be tied to others at all."""
    known = [part.isNotNull() for part in _linkage().values()]
    return F.when(known[0] & known[1] & known[2] & known[3], "linkage_available").otherwise("insufficient_linkage")


def _found_by_report(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """(key, date, report_id, ids): findings that can tie to others, by key, day and report; and the columns of the key."""
    parts = [part.alias(name) for name, part in _linkage().items()]
    rows = unfold(found.where(recurrence_status() == "linkage_available"), "findings", "f", *parts, report_key().alias("report_id"))
    rows = rows.where("f.category is not null and f.defect.assertion in ('present', 'possible')").withColumn("category", F.col("f.category"))
    key = ["vendor", "kind", "thing", "category"]
    return rows.groupBy(*key, "date", "report_id").agg(F.collect_set("f.finding_id").alias("ids")), key


def recurrence(found: DataFrame) -> DataFrame:
    """(finding_id, previous): earlier findings of the same vendor, asset (else batch) and category in other reports.

    Only findings that are present or possible take part, and only of records that
    recurrence_status() calls linkable. Findings of a key come together by day and report, and a
    running frame up to the day before gives each day what was found earlier, once: a key takes a
    row a day into its window, however many findings it has, and never a row a pair.
    """
    reports, key = _found_by_report(found)
    days = reports.groupBy(*key, "date").agg(F.collect_list(F.struct("report_id", "ids")).alias("reports"))
    earlier = F.collect_list("reports").over(Window.partitionBy(*key).orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumn("earlier", F.flatten(earlier)).where(F.size("earlier") > 0)
    own = days.select("earlier", F.explode("reports").alias("r"))
    others = F.flatten(F.transform(F.filter("earlier", lambda e: e["report_id"] != F.col("r.report_id")), lambda e: e["ids"]))
    told = own.select("r.ids", F.array_sort(F.array_distinct(others)).alias("previous")).where(F.size("previous") > 0)
    return told.select(F.explode("ids").alias("finding_id"), "previous")


def recurrence_counts(found: DataFrame) -> DataFrame:
    """(finding_id, n_previous): how many earlier findings recurrence() lists for each, without the lists.

    What a key had up to the day before, less what the finding's own report had by then. Both are
    running sums, over a row a day of a key and over the days of a report, so work grows with the
    findings and not with the pairs. A finding's id stands under one report and day.
    """
    reports, key = _found_by_report(found)
    reports = reports.withColumn("n", F.size("ids"))
    past = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = reports.groupBy(*key, "date").agg(F.sum("n").alias("n")).select(*key, "date", past(*key).alias("before")).where("before > 0")
    own = reports.withColumn("own", past(*key, "report_id"))
    told = own.join(days, [*key, "date"]).withColumn("n_previous", F.col("before") - F.col("own")).where("n_previous > 0")
    return told.select(F.explode("ids").alias("finding_id"), "n_previous")


def export_scope(found: DataFrame, rows: DataFrame) -> DataFrame:
    """All records, with only the selected findings and their evidence."""
    chosen = rows.groupBy("record_id").agg(F.collect_set("finding_id").alias("chosen"))
    out = found.join(chosen, "record_id", "left").withColumn("chosen", F.coalesce("chosen", F.expr("cast(array() as array<string>)")))
    out = out.withColumn("picked", F.filter("findings", lambda f: F.array_contains("chosen", f["finding_id"])))
    evidence = F.flatten(F.transform("picked", lambda f: F.concat(F.array(f["defect"]), f["links"])))
    keys = F.transform(evidence, lambda e: F.struct(e["label"], e["start"], e["stop"]))
    keep = lambda e: (F.size("picked") == F.size("findings")) | F.array_contains(keys, F.struct(e["label"], e["start"], e["stop"]))
    return out.withColumn("entities", F.filter("entities", keep)).withColumn("findings", F.col("picked")).drop("picked", "chosen", "shown")


def integrity(found: DataFrame) -> DataFrame:
    """(violations, loose): spans whose text is not what stands at their offsets, and evidence of findings that is no entity."""
    wrong = F.filter("entities", lambda e: F.substring(F.col("narrative"), e["start"] + 1, e["stop"] - e["start"]) != e["text"])
    loose = F.filter(F.flatten(F.transform("findings", lambda f: F.concat(F.array(f["defect"]), f["links"]))), lambda e: ~F.array_contains("entities", e))
    zero = F.lit(0).cast("long")
    return found.agg(F.coalesce(F.sum(F.size(wrong)), zero).alias("violations"), F.coalesce(F.sum(F.size(loose)), zero).alias("loose"))
