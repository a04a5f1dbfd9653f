"""Human corrections, gold gates, hybrid merging and invariance checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators.extract import CONFIDENCE, LINKED, assertion, keep_first

# Labels of spans and of their assertions.
LABELS = ("VENDOR", "PRODUCT", "COMPONENT", "MATERIAL", "DEFECT", "LOCATION", "MEASUREMENT", "INSPECTION_METHOD", "REPORTED_SEVERITY", "CAUSE", "CORRECTIVE_ACTION", "DATE")
ASSERTIONS = ("present", "negated", "possible", "historical", "resolved")


def edit_violations(edits: DataFrame, records: DataFrame, text_col: str = "narrative") -> DataFrame:
    """(record_id, start, stop, violation) of edited spans that are no valid evidence; overlaps are found by lag over a record's spans."""
    rows = edits.join(records.select("record_id", F.length(text_col).alias("size")), "record_id", "left")
    before = F.max("stop").over(Window.partitionBy("record_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)
    reason = (
        F.when(F.col("size").isNull(), "unknown_record").when((F.col("start") < 0) | (F.col("stop") > F.col("size")) | (F.col("stop") <= F.col("start")), "out_of_bounds")
        .when(~F.col("label").isin(*LABELS), "unknown_label").when(~F.coalesce(F.col("assertion"), F.lit("present")).isin(*ASSERTIONS), "unknown_assertion").when(F.col("start") < F.col("before"), "overlap")
    )
    return rows.withColumn("violation", reason).where("violation is not null").select("record_id", "start", "stop", "violation")


def human_entities(edits: DataFrame, records: DataFrame, text_col: str = "narrative") -> DataFrame:
    """Edited spans as evidence: text from the narrative, full confidence, method human."""
    rows = edits.join(records.select("record_id", text_col), "record_id")
    return rows.select("record_id", "label", F.substring(F.col(text_col), F.col("start") + 1, F.col("stop") - F.col("start")).alias("text"), "start", "stop", "assertion", F.lit(CONFIDENCE["human"]).alias("confidence"), F.lit("human").alias("method"))


def edited_links(edits: DataFrame, spans: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edits(finding_id, record_id, label, start, stop) to (valid links, each once; violations)."""
    from gaugeline.scratch import materialise

    known = findings.select("finding_id").distinct().withColumn("known", F.lit(True))
    evidence = spans.where(F.col("label").isin(*LINKED)).dropDuplicates(["record_id", "label", "start", "stop"]).select("record_id", "label", "start", "stop", "text", F.lit(True).alias("found"))
    told = edits.join(known, "finding_id", "left").join(evidence, ["record_id", "label", "start", "stop"], "left")
    # both results are read from here: spans and findings are asked for once, and only this narrow table is kept
    told = materialise(told.withColumn("valid", F.col("known").isNotNull() & F.col("found").isNotNull()).drop("known", "found"), "edited-links")
    links = told.where("valid").drop("valid").dropDuplicates(["finding_id", "label", "start", "stop"])
    wrong = told.where("not valid").select(*edits.columns).join(links, ["finding_id", "label", "start", "stop"], "left_anti")
    return links, wrong


def gold_gates(gold: DataFrame) -> DataFrame:
    """(record_id, reasons) of gold rows that must not be used."""
    repeated = F.count("*").over(Window.partitionBy("record_id")) > 1
    gates: Mapping[str, Column] = {
        "privacy_not_reviewed": ~F.coalesce("privacy_reviewed", F.lit(False)),
        "source_not_human": F.coalesce("annotation_source", F.lit("")) != "human",
        "not_adjudicated": F.coalesce("annotation_status", F.lit("")) != "adjudicated",
        "too_few_annotators": F.size(F.array_distinct(F.coalesce("annotator_ids", F.expr("cast(array() as array<string>)")))) < 2,
        "no_adjudicator": F.coalesce("adjudicator_id", F.lit("")) == "",
        "no_version": F.coalesce("annotation_version", F.lit("")) == "",
        "repeated_record": repeated,
    }
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in gates.items()]))
    return gold.withColumn("reasons", reasons).where(F.size("reasons") > 0).select("record_id", "reasons")


def aligned(text: Column, start: Column, stop: Column) -> Column:
    """Whether a span begins and ends at word edges."""
    edge = lambda a, b: ~(a.rlike(r"\w$") & b.rlike(r"^\w"))
    return edge(F.substring(text, F.lit(1), start), F.substring(text, start + 1, F.length(text))) & edge(F.substring(text, F.lit(1), stop), F.substring(text, stop + 1, F.length(text)))


def hybrid(entities: Column, tagged: Column, threshold: float = 0.5) -> Column:
    """Rule spans of enough confidence first, then tagged spans that overlap none of them; in order of start."""
    return F.array_sort(keep_first(F.concat(F.filter(entities, lambda e: e["confidence"] >= threshold), tagged)), lambda a, b: a["start"] - b["start"])


def tagged_spans(text: Column, spans: Column, label: str) -> Column:
    """Spans of a tagger as entities with its fixed confidence."""
    return F.transform(
        spans,
        lambda s: F.struct(F.lit(label).alias("label"), s["text"].alias("text"), s["start"].alias("start"), s["stop"].alias("stop"), assertion(text, s["start"], s["stop"]).alias("assertion"), F.lit(CONFIDENCE["ner"]).alias("confidence"), F.lit("ner").alias("method")),
    )


def terms_seen(spans: DataFrame, least: int = 2) -> DataFrame:
    """(term, label, n) of all terms that reviewed spans have at least `least` times."""
    return spans.groupBy(F.lower("text").alias("term"), "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def induce_terms(spans: DataFrame, least: int = 2) -> dict[str, list[str]]:
    """A lexicon from reviewed spans: a pack of terms_seen() by frequency, as large as reviewers' own terms are many; tagger.train() is for more."""
    out: dict[str, list[str]] = {}
    for r in terms_seen(spans, least).orderBy(F.desc("n"), "term", "label").toLocalIterator():
        out.setdefault(r["label"], []).append(r["term"])
    return out


def signature(entities: Column) -> Column:
    """What an extraction says, without places: sorted (label, text, assertion); vendors left out."""
    kept = F.filter(entities, lambda e: e["label"] != "VENDOR")
    return F.array_sort(F.transform(kept, lambda e: F.struct(e["label"].alias("label"), F.lower(T.collapse(e["text"])).alias("text"), e["assertion"].alias("assertion"))))


def changed(one: DataFrame, other: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """Keys whose signatures differ."""
    a, b = one.select(*keys, signature(F.col("entities")).alias("s")), other.select(*keys, signature(F.col("entities")).alias("t"))
    return a.join(b, list(keys)).where(F.to_json("s") != F.to_json("t")).select(*keys)


# What a workflow, a priority and a threshold may be.
WORKFLOWS = ("pending", "in_progress", "reviewed")
PRIORITIES = ("high", "normal", "low", "disabled")


def settings_violations(rows: DataFrame) -> DataFrame:
    """(record_id, field) of rows(record_id, workflow, priority, threshold) with a value out of range; null is out of range."""
    good = {"workflow": F.col("workflow").isin(*WORKFLOWS), "priority": F.col("priority").isin(*PRIORITIES), "threshold": F.col("threshold").between(0.0, 1.0)}
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in good.items()]))
    return rows.select("record_id", F.explode(bad).alias("field"))


def corrected_entities(spans: DataFrame) -> DataFrame:
    """(record_id, entities): spans of a record together, in order of start; its text bounds them."""
    from gaugeline.operators.extract import ENTITY

    kind = ENTITY.removeprefix("struct<").removesuffix(">")
    entity = F.struct(*[F.col(f.split(":")[0]) for f in kind.split(",")]).cast(ENTITY)
    return spans.groupBy("record_id").agg(F.array_sort(F.collect_list(entity), lambda a, b: a["start"] - b["start"]).alias("entities"))


def recomputed(rows: DataFrame, links: DataFrame | None, text_col: str = "narrative") -> DataFrame:
    """rows with entities and clauses, and the findings, candidates and statuses that follow; of links only those given stay."""
    from gaugeline.operators.extract import findings, statuses

    out = findings(statuses(rows, text_col))
    if links is None:
        return out
    kept = links.groupBy("finding_id").agg(F.collect_set(F.struct("label", "start", "stop")).alias("kept"))
    kept = kept.withColumn("record_id", F.regexp_extract("finding_id", "^(.*):defect:", 1)).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("finding_id", "kept"))).alias("kept"))
    none = F.expr("cast(array() as array<struct<label:string,start:int,stop:int>>)")
    in_kept = lambda f: F.filter(f["links"], lambda e: F.array_contains(F.coalesce(F.try_element_at("kept", f["finding_id"]), none), F.struct(e["label"].alias("label"), e["start"].alias("start"), e["stop"].alias("stop"))))
    return out.join(kept, "record_id", "left").withColumn("findings", F.transform("findings", lambda f: f.withField("links", in_kept(f)))).drop("kept")


def payload(found: DataFrame, edits: DataFrame, note: Column, packs: Sequence = (), text_col: str = "narrative", links: DataFrame | None = None) -> DataFrame:
    """A review of each record that has edits: corrected entities in place of the extracted ones, and findings, candidates and statuses that follow from them.

    found: extracted records with clauses; edits(record_id, label, start, stop, assertion); links
    (finding_id, label, start, stop), where given, are the only links that stay.
    """
    spans = human_entities(edits, found, text_col)
    base = found.select("record_id", "domain", text_col, "clauses", F.col("entities").alias("original_entities"))
    out = recomputed(base.join(corrected_entities(spans), "record_id"), links, text_col)
    return out.select("record_id", "domain", text_col, "original_entities", F.col("entities").alias("corrected_entities"), F.col("findings").alias("corrected_findings"), F.col("review_candidates").alias("corrected_review_candidates"), "mapping_status", "assertion_status", F.trim(note).alias("note"), F.lit("human").alias("label_origin"))


def tagged_only(records: DataFrame, tagged: Column, text_col: str = "narrative") -> DataFrame:
    """records as a tagger alone sees them: its spans as entities, and clauses, candidates, statuses and findings that follow."""
    from gaugeline.operators.extract import clauses, findings, no_entities, statuses

    ordered = F.array_sort(keep_first(F.coalesce(tagged, no_entities())), lambda a, b: a["start"] - b["start"])
    return findings(statuses(records.withColumns({"entities": ordered, "clauses": clauses(F.col(text_col))}), text_col))
