"""Queries of evaluation, sealed tests, displays, contextual evidence and prepared texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators import analytics as A
from gaugeline.operators import contextual as X
from gaugeline.operators import display as D
from gaugeline.operators import evaluate as E
from gaugeline.operators import extract as EX
from gaugeline.operators import review as R
from gaugeline.plans import corpus as pc
from gaugeline.plans import fixtures as fx
from gaugeline.plans.catalogue import register
from gaugeline.plans.review import PRF, SIDES, _prf, sides, spans
from gaugeline.session import table

_FRAME = "frame(label, place) as (values ('VENDOR', 0), ('PRODUCT', 1), ('COMPONENT', 2), ('MATERIAL', 3), ('DEFECT', 4), ('LOCATION', 5), ('MEASUREMENT', 6), ('INSPECTION_METHOD', 7), ('REPORTED_SEVERITY', 8), ('CAUSE', 9), ('CORRECTIVE_ACTION', 10), ('DATE', 11))"


@register("label_frame_scores", f"with {fx.SPANS_SQL}, {SIDES}, {_FRAME}, m as ({'with ' + _prf('record_id, start, stop, label', 'label')}) select f.label, place, coalesce(predicted, 0) as predicted, coalesce(reference, 0) as reference, coalesce(correct, 0) as correct, coalesce(precision, 0) as precision, coalesce(recall, 0) as recall, coalesce(f1, 0) as f1 from frame f left join m using (label)")
def label_frame_scores(spark, d):
    """Scores of all twelve labels in their order, also of those that no report has."""
    return E.per_label(*sides(spark, d), R.LABELS)


@register("score_errors", f"with {fx.SPANS_SQL}, {SIDES}, a as (select record_id, start, stop, label from p), b as (select record_id, start, stop, label from g) select record_id, 'extra_entity' as kind, start::int as start, stop::int as stop, label from (select * from a except select * from b) union all select record_id, 'missed_entity', start::int, stop::int, label from (select * from b except select * from a)")
def score_errors(spark, d):
    return E.errors(*sides(spark, d))


def _slice_sql() -> str:
    fields = {"vendor": "vendor", "industry": "domain", "template": "template::varchar", "year": "coalesce(substr(report_date, 1, 4), 'Unknown')"}
    long = " union all ".join(f"select record_id, '{k}' as field, {v} as value from reports" for k, v in fields.items())
    return f"with {fx.SPANS_SQL}, sl as materialized ({long}), p as (select s.*, field, value from spans s join sl using (record_id) where start % 11 <> 2), g as (select s.*, field, value from spans s join sl using (record_id) where start % 7 <> 1), {_prf('record_id, field, value, start, stop, label', 'field, value')}"


@register("slices_of_scores", _slice_sql())
def slices_of_scores(spark, d):
    """Scores by vendor, industry, template and year in one pass."""
    records = fx.reports(spark, d).select("record_id", "vendor", F.col("domain").alias("industry"), "template", F.substring("report_date", 1, 4).alias("year"))
    return E.sliced(*sides(spark, d), records, ["vendor", "industry", "template", "year"])


@register("best_threshold", f"with {fx.SPANS_SQL}, t as (select unnest([0.5, 0.75, 0.95])::double as threshold), p as (select s.*, threshold from spans s, t where confidence >= threshold and start % 11 <> 2), g as (select s.*, threshold from spans s, t where start % 7 <> 1), m as ({'with ' + _prf('record_id, start, stop, label, threshold', 'threshold')}) select * from m order by f1 desc, threshold desc limit 1")
def best_threshold(spark, d):
    return E.best_threshold(E.calibrate(*sides(spark, d), [0.5, 0.75, 0.95]))


@register("held_out_domain_scores", f"with {fx.SPANS_SQL}, kn as (select distinct h.domain, s.label from (select distinct domain from reports) h join (select distinct domain, label from spans join reports using (record_id) where label <> 'MEASUREMENT') s on s.domain <> h.domain), sd as (select s.*, r.domain from spans s join reports r using (record_id) join kn on kn.domain = r.domain and kn.label = s.label), p as (select * from sd where start % 11 <> 2), g as (select * from sd where start % 7 <> 1), m as ({'with ' + _prf('record_id, start, stop, label, domain', 'domain')}), n as (select domain, count(*) as records from reports group by domain), ln as (select domain, string_agg(label, ',' order by label) as compatible_labels from kn group by domain) select * from n join ln using (domain) left join m using (domain)")
def held_out_domain_scores(spark, d):
    """Each domain scored on the labels that the other domains have, as if it had been held out."""
    domains = fx.reports(spark, d).select("record_id", "domain")
    predicted, gold = sides(spark, d)
    have = spans(spark, d).where("label <> 'MEASUREMENT'").select("record_id", "label").join(domains, "record_id").select("domain", "label").distinct()
    names = domains.select("domain").distinct()
    others = F.broadcast(names).join(have.select(F.col("domain").alias("of"), "label"), F.col("domain") != F.col("of")).select("domain", "label").distinct()
    return E.held_out_scores(predicted, gold, domains, others)


@register("sealed_test", f"with {fx.SPANS_SQL}, t as (select record_id from reports where template % 3 = 2), p as (select * from spans where start % 11 <> 2 and record_id in (select record_id from t)), g as (select * from spans where start % 7 <> 1 and record_id in (select record_id from t)), m as ({'with ' + _prf('record_id, start, stop, label')}) select 'verified_manifest' as isolation, * from m")
def sealed_test(spark, d):
    """Only the test records of a partition are scored, with a model that saw none of them."""
    records = fx.reports(spark, d).select("record_id", "template")
    assigned = records.select("record_id", F.when(F.col("template") % 3 == 2, "test").otherwise("train").alias("split"))
    status, test = E.sealed(records, assigned, records.where("template % 3 = 0").select("record_id"), trained_on="m1")
    kept = [x.join(test.select("record_id"), "record_id", "left_semi") for x in sides(spark, d)]
    return E.metrics(*kept, E.SPAN).select(F.lit(status).alias("isolation"), "*")


@register("paired_predictions", f"with {fx.SPANS_SQL} select domain, count(distinct r.record_id) as n, count(s.record_id) as spans from reports r left join spans s using (record_id) group by domain")
def paired_predictions(spark, d):
    """Gold records joined to their predictions; one that is missing or doubled would fail the query."""
    gold = fx.reports(spark, d).select("record_id", "domain")
    found = fx.spanned(spark, d).select("record_id", F.size("entities").alias("n"))
    return E.paired(D.blank_predictions(gold), found).groupBy("domain").agg(F.count("*").alias("n"), F.sum("n").cast("long").alias("spans"))


#: One stored report for each source of the documents: how well "long means English" does by language, and whether that was measured.
_SAVED = "cells as (select source as name, lang as label, count(*) as support, round(count(*) filter (n_chars > 1000) / count(*)::double, 6) as f1 from documents where source is not null group by all), told as (select name, label, support, f1, hash_name % 3 = 0 as planned, hash_name % 2 = 0 as moded from (select *, length(name) + ascii(right(name, 1)) as hash_name from cells))"


def saved(spark, d):
    """(name, report JSON): a report a source."""
    cells = table(spark, d, "documents").where("source is not null").groupBy(F.col("source").alias("name"), F.col("lang").alias("label")).agg(F.count("*").alias("support"), F.round(F.count_if(F.col("n_chars") > 1000) / F.count("*"), 6).alias("f1"))
    classes = F.map_from_entries(F.collect_list(F.struct("label", F.struct(F.col("f1").alias("f1-score"), F.col("support").cast("double").alias("support")))))  # of a source, one a language
    each = cells.groupBy("name").agg(classes.alias("per_class"), F.round(F.avg("f1"), 6).alias("macro_f1"))
    number = F.length("name") + F.ascii(F.right("name", F.lit(1)))
    averages = F.create_map(F.lit("macro avg"), F.struct(F.col("macro_f1").alias("f1-score"), F.lit(0.0).alias("support")))
    test = F.struct("macro_f1", F.map_concat("per_class", averages).alias("per_class"))
    return each.select("name", F.to_json(F.struct(F.when(number % 3 == 0, "planned").otherwise("measured").alias("status"), F.when(number % 2 == 0, "vendor").alias("partition_mode"), test.alias("test"))).alias("report"))


@register("measured_reports", f"with {_SAVED} select name, label, f1, support::double as support from told where not planned and moded")
def measured_reports(spark, d):
    """Only reports that were measured on a partition are shown, by class and without averages."""
    return E.measured(saved(spark, d))


@register("report_summary", f"with {_SAVED}, named as (select name, row_number() over (order by name) - 1 as place from (select distinct name from told) order by name limit 3) select place::int as place, 'experiment ' || name as experiment, 'one source' as scope, 'macro_f1' as metric, round(avg(f1), 6) as value from told join named using (name) group by all")
def report_summary(spark, d):
    """The table of a page that names three reports, in its order."""
    reports = saved(spark, d)
    names = [r.name for r in reports.select("name").orderBy("name").limit(3).collect()]
    return E.summary_table(reports, [(f"experiment {n}", "one source", n, "$.test.macro_f1") for n in names])


@register("evidence_display", f"with {fx.FINDINGS_SQL} select finding_id, f.vendor, coalesce(case when f.batch like '%1' then null else f.batch end, 'file-' || f.domain) as report, f.date, defect, evidence, assertion, priority, array_to_string(component, ', ') as component, array_to_string(material, ', ') as material, array_to_string(severity, ', ') as severity, reasons from findings f")
def evidence_display(spark, d):
    found = fx.extracted(spark, d)
    records = fx.reports(spark, d).select("record_id", F.when(F.col("batch").endswith("1"), "").otherwise(F.col("batch")).alias("report_number"), F.concat(F.lit("file-"), "domain").alias("source_document"))
    return D.evidence(A.finding_rows(found), records)


@register("record_states", f"with {fx.FINDINGS_SQL}{fx.CANDIDATES_SQL} select record_id, case when report_status = 'reviewed' then 'Reviewed' when record_id in (select record_id from spans where label = 'DEFECT') or record_id in (select record_id from candidates) then 'Needs review' when regexp_matches(narrative, '(?i)\\bno\\s+(?:material\\s+)?(?:defects?|deficiencies|damage)\\s+(?:(?:was|were)\\s+)?(?:found|observed|detected)\\b') then 'Explicit no-defect wording' else 'No supported defect extracted' end as state from reports")
def record_states(spark, d):
    return fx.spanned(spark, d).select("record_id", D.state().alias("state"))


@register("version_counts", "select case when event_id % 7 = 0 then 'unknown' else 'v' || event_id % 3 end as version, event_type as mode, count(*) as narratives from events group by all")
def version_counts(spark, d):
    metadata = F.map_filter(F.create_map(F.lit("extractor_version"), F.expr("case when event_id % 7 <> 0 then concat('v', event_id % 3) end"), F.lit("extraction_mode"), F.col("event_type")), lambda k, v: v.isNotNull())
    return D.version_counts(table(spark, d, "events").select(metadata.alias("document_metadata")))


@register("run_times", "select e.event_id, r.ts as run_at from events e join events r on r.event_id = e.event_id // 10 * 10")
def run_times(spark, d):
    rows = table(spark, d, "events")
    runs = rows.where("event_id % 10 = 0").select(F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"))
    return D.with_run_times(rows.select("event_id", F.expr("event_id div 10 * 10").alias("run_id")), runs).select("event_id", "run_at")


@register("settings_violations", "select event_id::varchar as record_id, unnest(list_filter([case when event_id % 4 > 2 then 'workflow' end, case when event_id % 5 = 4 then 'priority' end, case when value > 50 then 'threshold' end], lambda x: x is not null)) as field from events")
def settings_violations(spark, d):
    i = F.col("event_id")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (i % n + 1).cast("int"))
    rows = table(spark, d, "events").select(i.cast("string").alias("record_id"), pick(["pending", "in_progress", "reviewed", "in_review"], 4).alias("workflow"), pick([*R.PRIORITIES, "none"], 5).alias("priority"), (F.col("value") / 50).alias("threshold"))
    return R.settings_violations(rows)


@register("input_signatures", "select sha256('{\"input_0\":' || event_id || ',\"input_1\":' || case when event_id % 3 = 0 then 'null' else '\"' || event_type || '\"' end || ',\"settings\":\"s\"}') as signature, event_id from events")
def input_signatures(spark, d):
    kind = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    return table(spark, d, "events").select("event_id", D.signature([F.col("event_id"), kind], F.lit("s")).alias("signature"))


@register("semantic_signatures", f"with {fx.SPANS_SQL} select record_id, string_agg(label || '|' || lower(text) || '|' || assertion, ';' order by label, lower(text), assertion) as signature from spans group by record_id")
def semantic_signatures(spark, d):
    found = fx.spanned(spark, d).where(F.size("entities") > 0)
    return found.select("record_id", F.array_join(F.transform(R.signature(F.col("entities")), lambda s: F.concat_ws("|", s["label"], s["text"], s["assertion"])), ";").alias("signature"))


def stub_parser(texts):
    """Words of a part list as chunks, subjects of nothing in particular: what a parser would say of the fixtures' sentences."""
    import re

    words = re.compile(r"\b(?:" + "|".join(fx.PARTS["COMPONENT"]) + r")\b", re.IGNORECASE)
    return [[X.Chunk(m.start(), m.end(), "nsubj", m.group(), "be", [X.Token(m.start(), m.end(), "NOUN")]) for m in words.finditer(t)] for t in texts]


@register("contextual_components", f"with {fx.FINDINGS_SQL} select distinct c.record_id, c.text, c.start::int as start, c.stop::int as stop, c.assertion, 0.6::double as confidence from spans c join defects d on d.record_id = c.record_id and d.clause_start <= c.start and c.start < d.clause_stop where c.label = 'COMPONENT'")
def contextual_components(spark, d):
    """Without the component pack, from a parser that is plugged in; only clauses with a defect count."""
    parser = X.available(stub_parser, X.PARSER_VERSION)
    found = X.add_contextual(EX.extract(fx.reports(spark, d)), parser)
    rows = T.unfold(found, "entities", "e", "record_id").where("e.method = 'contextual'")
    return rows.select("record_id", "e.text", "e.start", "e.stop", "e.assertion", "e.confidence")


_RAW = "'  ' || replace(coalesce(text, ''), ' ', case when turn % 3 = 0 then chr(13) || chr(10) || chr(9) when turn % 3 = 1 then ' ' else chr(13) end) || case when turn % 2 = 0 then ' Call josé@example.com  now ' else '' end"
_LINES = f"replace(replace({_RAW}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_REDACTED = _LINES
for _name in ("email", "phone", "coordinates", "named_coordinate", "street"):
    _REDACTED = rf"regexp_replace({_REDACTED}, '{pc.DETECT[_name]}', '\1[REDACTED]', 'g')"


@register("prepared_evidence", f"with a as (select conv_id, turn, {_LINES} as l, {_REDACTED} as r from conversations), b as (select *, regexp_replace(r, '^\\s+|\\s+$', '', 'g') as display from a), c as (select *, regexp_replace(display, '\\s+', ' ', 'g') as clean, list_append(list_filter(range(0, length(display)), lambda i: i = 0 or not (regexp_matches(substr(display, i + 1, 1), '\\s') and regexp_matches(substr(display, i, 1), '\\s'))), length(display)) as offsets from b) select conv_id, turn, display, clean, array_to_string(offsets, ',') as offsets, r <> l as sensitive from c")
def prepared_evidence(spark, d):
    """Texts with all kinds of line ends and an address beyond ASCII: lines kept for display, one line for reading, and the map between."""
    raw = F.concat(F.lit("  "), F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.expr("case when turn % 3 = 0 then '\\r\\n\\t' when turn % 3 = 1 then ' ' else '\\r' end")), F.expr("case when turn % 2 = 0 then ' Call josé@example.com  now ' else '' end"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.prepare_evidence(raw).alias("c"))
    return rows.select("conv_id", "turn", F.col("c.display").alias("display"), F.col("c.clean").alias("clean"), F.array_join(F.transform("c.offsets", lambda x: x.cast("string")), ",").alias("offsets"), F.col("c.sensitive").alias("sensitive"))


@register("vendor_aliases", "select event_id, case lower(trim(regexp_replace(v, '\\s+', ' ', 'g'))) when 'acme works' then 'acme' when 'a.w.' then 'acme' else lower(trim(regexp_replace(v, '\\s+', ' ', 'g'))) end as vendor_key from (select event_id, case event_id % 4 when 0 then ' ACME   Works ' when 1 then 'A.W.' when 2 then 'Other ' || user_id % 5 else '' end as v from events)")
def vendor_aliases(spark, d):
    vendor = F.expr("case event_id % 4 when 0 then ' ACME   Works ' when 1 then 'A.W.' when 2 then concat('Other ', user_id % 5) else '' end")
    return table(spark, d, "events").select("event_id", T.vendor_key(vendor, {"Acme works": "ACME", "a.w.": "Acme"}).alias("vendor_key"))


@register("review_payloads", f"with {fx.FINDINGS_SQL}, e as (select * from spans where start % 7 <> 1), rd as (select r.*, coalesce(c.start, r.start) as cs, coalesce(c.stop, r.stop) as ct from e r left join clauses c on c.record_id = r.record_id and c.start <= r.start and r.start < c.stop where label = 'DEFECT'), rl as (select d.record_id, d.start as ds, x.label, count(*) filter (x.label = 'DEFECT') over (partition by d.record_id, d.start) as nd, count(*) over (partition by d.record_id, d.start, x.label) as nl from rd d join e x on x.record_id = d.record_id and d.cs <= x.start and x.stop <= d.ct) select e.record_id, count(*)::int as entities, count(*) filter (e.label = 'DEFECT')::int as findings, (select count(*) from rl where rl.record_id = e.record_id and nd = 1 and nl = 1 and rl.label in ({', '.join(repr(x) for x in EX.LINKED)}))::int as links from e group by e.record_id")
def review_payloads(spark, d):
    """Reviews that take some spans away: entities, findings and links follow from what is left."""
    found = fx.spanned(spark, d)
    kept = spans(spark, d).where("start % 7 <> 1").select("record_id", "label", "start", "stop", "assertion")
    out = R.payload(found, kept, F.lit(" checked "))
    links = F.aggregate("corrected_findings", F.lit(0), lambda n, f: n + F.size(f["links"]))
    return out.select("record_id", F.size("corrected_entities").alias("entities"), F.size("corrected_findings").alias("findings"), links.alias("links"))


@register("tagger_only_findings", f"with {fx.REPORTS_SQL}, h as (select record_id, regexp_extract(narrative, '(cracked|leaking|corroded|worn|damaged)') as word, narrative from reports where regexp_matches(narrative, '(cracked|leaking|corroded|worn|damaged)')) select record_id, word as text, (strpos(narrative, word) - 1)::int as start, 'ner' as method, 0.5::double as confidence from h")
def tagger_only_findings(spark, d):
    """Findings from a tagger alone, here one that tags the first state of damage."""
    text = F.col("narrative")
    first = F.slice(R.tagged_spans(text, T.find_spans(text, "cracked|leaking|corroded|worn|damaged"), "DEFECT"), 1, 1)
    rows = T.unfold(R.tagged_only(fx.reports(spark, d), first), "findings", "f", "record_id")
    return rows.select("record_id", "f.defect.text", "f.defect.start", "f.defect.method", "f.defect.confidence")


@register("saved_revisions", f"with {fx.FINDINGS_SQL}{fx.CANDIDATES_SQL}, rv as (select record_id, coalesce(report_status, 'pending') as workflow from reports where template <> 4 or report_status is not null), e as (select * from spans where start % 7 <> 1 and record_id in (select record_id from rv)), open_ as (select record_id from e where label = 'DEFECT' union select c.record_id from (select record_id, start, stop from clauses) c join reports r on r.record_id = c.record_id where regexp_matches(substr(narrative, c.start + 1, c.stop - c.start), '(?i)\\b(?:inspect\\w*|observ\\w*|detect\\w*|exhibits|shows|found|repair\\w*|replace\\w*|reject\\w*|abnormal\\w*|nonconform\\w*)\\b') and not regexp_matches(substr(narrative, c.start + 1, c.stop - c.start), '(?i)\\bno\\s+(?:material\\s+)?(?:defects?|deficiencies|damage)\\s+(?:(?:was|were)\\s+)?(?:found|observed|detected)\\b') and not exists (select 1 from e where e.record_id = c.record_id and e.label = 'DEFECT' and c.start <= e.start and e.start < c.stop)) select rv.record_id, workflow, case when workflow = 'reviewed' then 'mapped' when rv.record_id in (select record_id from open_) then 'review_required' else 'unmapped' end as mapping_status, (select count(*) from e where e.record_id = rv.record_id)::int as entities, (select count(*) from e where e.record_id = rv.record_id and label = 'DEFECT')::int as findings, 'human' as label_origin from rv")
def saved_revisions(spark, d):
    """Reviews that take some spans away, saved as revisions of a run and read back as the newest state of their records."""
    import uuid

    from gaugeline.operators import revise
    from gaugeline.operators.store import Library
    from gaugeline.scratch import materialise, shared_dir

    found = materialise(fx.spanned(spark, d), "extracted")
    library = Library(spark, f"{shared_dir(spark)}/library-{uuid.uuid4().hex}")
    run = library.save_run(found.select("record_id", F.to_json(F.struct("record_id", "narrative")).alias("payload")), {"pack": "parts"})
    reviews = fx.reports(spark, d).where("template <> 4 or report_status is not null").select("record_id", F.coalesce("report_status", F.lit("pending")).alias("workflow"), F.lit(" checked ").alias("note"))
    edits = T.unfold(found, "entities", "e", "record_id").select("record_id", "e.label", "e.start", "e.stop", "e.assertion").where("start % 7 <> 1")
    rows = revise.as_payload(revise.revisions(found, reviews, edits).join(run.select("run_id", "record_id"), "record_id").withColumn("base_id", F.lit(None).cast("bigint")))
    library.save_reviews(rows)
    shape = "record_id string, workflow string, mapping_status string, label_origin string, note string, entities array<struct<label:string>>, findings array<struct<finding_id:string>>"
    saved = library.records().select(F.from_json("payload", shape).alias("p")).select("p.*").where("note = 'checked'")
    return saved.select("record_id", "workflow", "mapping_status", F.size("entities").alias("entities"), F.size("findings").alias("findings"), "label_origin")


@register("gold_line_checks", f"with {fx.FINDINGS_SQL}, g as (select *, length(narrative) % 5 as k, length(narrative) % 3 as m from reports), n as (select record_id, count(*) as n, count(*) filter (label = 'DEFECT') as d from spans group by 1) select record_id, array_to_string(list_filter([case when k = 1 and n > 0 then 'unknown_label' end, case when k = 2 and n > 0 then 'other_text' end, case when m = 1 and n > 0 then 'not_by_human' end, case when k = 1 and d > 0 then 'defects_without_finding' when k = 3 and d > 0 then 'defects_without_finding' end], lambda x: x is not null), ',') as violations from g join n using (record_id) where (k in (1, 2) and n > 0) or (m = 1 and n > 0) or (k = 3 and d > 0)")
def gold_line_checks(spark, d):
    """Gold lines made of reports; by the length of their text some have a label that is none, a text from elsewhere, a machine's span or no finding."""
    from gaugeline.operators import revise

    found, k, m = fx.extracted(spark, d), F.length("narrative") % 5, F.length("narrative") % 3
    entity = lambda e: F.struct(F.when(k == 1, F.lit("REGULATION")).otherwise(e["label"]).alias("label"), F.when(k == 2, F.concat(e["text"], F.lit("?"))).otherwise(e["text"]).alias("text"), e["start"].alias("start"), e["stop"].alias("stop"), e["assertion"].alias("assertion"), F.when(m == 1, "ruler").otherwise("human").alias("method"))
    places = F.transform("findings", lambda f: F.struct(f["defect"]["start"].alias("start"), f["defect"]["stop"].alias("stop")))
    lines = found.select("record_id", F.col("narrative").alias("display_text"), F.transform("entities", entity).alias("entities"), F.when(k != 3, places).alias("findings"))
    return revise.line_violations(lines).select("record_id", F.array_join("violations", ",").alias("violations"))


@register("tagger_scores")
def tagger_scores(spark, d):
    """A tagger trained on reports of six components, and the terms seen there as a lexicon, on reports of the three others."""
    from gaugeline.operators import tagger as G
    from gaugeline.scratch import materialise

    labels = ["COMPONENT", "MATERIAL", "DEFECT"]
    found = fx.spanned(spark, d)
    named = F.filter("entities", lambda e: e["label"].isin(*labels))
    rows = materialise(found.select("record_id", F.col("narrative").alias("text"), F.transform(named, lambda e: F.struct(e["start"], e["stop"], e["label"])).cast(G.SPANS).alias("spans"), F.col("narrative").rlike(r"(?i)\b(plate|rod|housing)\b").alias("held_out")), "tagger-reports")
    seen, unseen = rows.where("not held_out"), rows.where("held_out")
    long = lambda df: df.select("record_id", "text", F.explode("spans").alias("s")).select("record_id", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), F.col("s.label").alias("label"), F.expr("substring(text, s.start + 1, s.stop - s.start)").alias("text"))
    known = R.terms_seen(long(seen)).select("term", "label")
    lexicon = long(unseen).withColumn("term", F.lower("text")).join(F.broadcast(known), ["term", "label"], "left_semi")
    keys = ["record_id", "start", "stop", "label"]
    told = G.score(G.train(seen, labels, 3)[3], unseen).select(F.lit("tagger").alias("method"), "*")
    return told.unionByName(E.metrics(lexicon, long(unseen), keys).select(F.lit("lexicon").alias("method"), "*"))


_BEFORE = r"len(regexp_extract_all(substring(narrative, 1, {}), '\w+|[^\w\s]'))"


@register("stored_spans", f"with {fx.SPANS_SQL} select record_id, start, stop, label, assertion, {_BEFORE.format('start')}::int as first_token, {_BEFORE.format('stop')}::int as after_token from spans join reports using (record_id)")
def stored_spans(spark, d):
    """Silver spans of all reports, written as a sealed store and read back under its seal."""
    from gaugeline.operators import spanstore
    from gaugeline.scratch import new_path, until_exit

    silver = {name: F.lit(value) for name, value in spanstore.SILVER.items()}
    entity = lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text"), e["start"].alias("start"), e["stop"].alias("stop"), e["assertion"].alias("assertion"))
    lines = fx.spanned(spark, d).select("record_id", F.lit("aviation").alias("domain"), F.lit("train").alias("split"), F.col("narrative").alias("text"), F.transform("entities", entity).alias("entities")).withColumns(silver)
    path = new_path(spark, "spans")
    spanstore.store_spans(lines, path, "silver")
    until_exit(spark, path)
    rows = spanstore.open_spans(spark, path, "silver").select("record_id", F.explode(F.arrays_zip("spans", "assertions")).alias("s"))
    return rows.select("record_id", "s.spans.start", "s.spans.stop", "s.spans.label", F.col("s.assertions").alias("assertion"), "s.spans.first_token", "s.spans.after_token")
