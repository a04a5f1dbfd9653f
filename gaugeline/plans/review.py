"""Queries of the store, of reviews, of evaluation and of exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators import evaluate as E
from gaugeline.operators import export as O
from gaugeline.operators import extract as X
from gaugeline.operators import store as S
from gaugeline.plans import fixtures as fx
from gaugeline.plans.catalogue import register
from gaugeline.session import table


def events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


VERSIONS = "select event_id, user_id, event_type, value from events where event_id % 3 <> 0"
REVISIONS = "select event_id, user_id, event_type, value from events where event_id % 3 = 0"


@register("latest_version", "select event_id, user_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as i from events) where i = 1")
def latest_version(spark, d):
    return S.latest(events(spark, d), ["user_id"], "event_id")


@register("latest_reviewed", f"with v as (select * from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as i from ({VERSIONS})) where i = 1), r as (select * from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as i from ({REVISIONS})) where i = 1) select v.event_id, v.user_id, v.event_type, case when r.event_id is not null then r.value else v.value end as value, r.event_id is not null as reviewed from v left join r using (user_id, event_type)")
def latest_reviewed(spark, d):
    rows = events(spark, d)
    return S.latest_reviewed(rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0"), ["user_id", "event_type"], "event_id", "value")


@register("insert_if_absent", "with s as (select distinct user_id, event_type from events where event_id % 5 = 0), i as (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events where event_id % 5 <> 0) select event_id, user_id, event_type, value from i where n = 1 and not exists (select 1 from s where s.user_id = i.user_id and s.event_type = i.event_type)")
def insert_if_absent(spark, d):
    rows = events(spark, d)
    return S.insert_if_absent(rows.where("event_id % 5 <> 0"), rows.where("event_id % 5 = 0"), ["user_id", "event_type"], "event_id")


@register("fk_violations", "select event_id from events r where event_id % 7 = 0 and not exists (select 1 from events v where v.event_id % 7 <> 0 and v.user_id = r.user_id and v.event_type = r.event_type)")
def fk_violations(spark, d):
    rows = events(spark, d)
    return rows.where("event_id % 7 = 0").join(rows.where("event_id % 7 <> 0"), ["user_id", "event_type"], "left_anti").select("event_id")


@register("legacy_review_match", "with rec as (select doc_id as id, doc_id + 100000 as legacy, source as text from documents), rev as (select event_id, case when event_id % 2 = 0 then user_id else user_id + 100000 end as ref, 'src' || (user_id % 20) as text from events), m as (select distinct event_id, id from rev join rec on (rev.ref = rec.id or rev.ref = rec.legacy) and rev.text = rec.text) select event_id, ref, text, count(id) as matches, case when count(id) = 1 then min(id) end as record from rev left join m using (event_id) group by all")
def legacy_review_match(spark, d):
    records = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") + 100000).alias("legacy"), F.col("source").alias("text"))
    reviews = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 100000).alias("ref"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("text"))
    return S.match_either(reviews, records, "ref", ["id", "legacy"], "text")


@register("import_outcomes", "with rec as (select doc_id as id, source as text from documents), rev as (select event_id, user_id as ref, 'src' || (user_id % 20) as text from events) select case when n = 1 then 'imported' else 'unmatched' end as status, count(*) as reviews from (select event_id, (select count(*) from rec where rec.id = ref and rec.text = rev.text) as n from rev) group by 1")
def import_outcomes(spark, d):
    records = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("text"))
    reviews = table(spark, d, "events").select("event_id", F.col("user_id").alias("ref"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("text"))
    found = S.match_either(reviews, records, "ref", ["id"], "text")
    return found.groupBy(F.when(F.col("matches") == 1, "imported").otherwise("unmatched").alias("status")).agg(F.count("*").alias("reviews"))


def spans(spark, d):
    rows = fx.spanned(spark, d)
    return T.unfold(rows, "entities", "e", "record_id", "vendor").select("record_id", "vendor", "e.label", "e.start", "e.stop", "e.assertion", "e.confidence")


#: What a reviewer changed, by a rule: some spans go, some get another assertion.
CORRECTED = "corrected as (select record_id, label, start, stop, case when label = 'DEFECT' and start % 5 = 0 then 'negated' else assertion end as assertion from spans where start % 7 <> 1)"


def corrected(rows):
    said = F.when((F.col("label") == "DEFECT") & (F.col("start") % 5 == 0), "negated").otherwise(F.col("assertion"))
    return rows.where("start % 7 <> 1").withColumn("assertion", said)


@register("review_outcomes_setops", f"with {fx.SPANS_SQL}, {CORRECTED}, k as (select record_id, label, start, stop, assertion from spans), c as (select * from corrected) select (select count(*) from (select * from k intersect select * from c)) as confirmed, (select count(*) from (select * from k except select * from c)) as removed_or_changed, (select count(*) from (select * from c except select * from k)) as added_or_changed")
def review_outcomes_setops(spark, d):
    rows = spans(spark, d)
    return E.review_outcomes(rows, corrected(rows), ["record_id", "label", "start", "stop", "assertion"])


@register("correction_types", f"with {fx.SPANS_SQL}, {CORRECTED} select case when c.record_id is null then 'Removed or boundary changed' when c.assertion = s.assertion then 'Confirmed' else 'Label or status changed' end as action, count(*) as n from spans s left join corrected c on c.record_id = s.record_id and c.start = s.start and c.stop = s.stop group by 1")
def correction_types(spark, d):
    rows = spans(spark, d)
    after = corrected(rows).select("record_id", "start", "stop", F.col("assertion").alias("now"))
    joined = rows.join(after, ["record_id", "start", "stop"], "left")
    action = F.when(F.col("now").isNull(), "Removed or boundary changed").when(F.col("now") == F.col("assertion"), "Confirmed").otherwise("Label or status changed")
    return joined.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@register("confidence_bands", f"with {fx.SPANS_SQL}, {CORRECTED} select case when confidence < 0.5 then '0-49%' when confidence < 0.75 then '50-74%' when confidence < 0.95 then '75-94%' else '95-100%' end as band, count(*) as findings, count(*) filter (c) as confirmed, round_even(count(*) filter (c) / count(*) * 100, 1) as confirmation_rate from (select s.confidence, c.record_id is not null as c from spans s left join corrected c on c.record_id = s.record_id and c.start = s.start and c.stop = s.stop and c.assertion = s.assertion) group by 1")
def confidence_bands(spark, d):
    rows = spans(spark, d)
    after = corrected(rows).select("record_id", "start", "stop", "assertion", F.lit(True).alias("c"))
    return E.confidence_bands(rows.join(after, ["record_id", "start", "stop", "assertion"], "left").select("confidence", F.coalesce("c", F.lit(False)).alias("confirmed")))


@register("lag_overlap_violations", "with s as (select conv_id, turn, turn * 10 as a, turn * 10 + length(text) % 25 as b from conversations) select conv_id, turn from (select *, lag(b) over (partition by conv_id order by a, b) as before from s) where a < before")
def lag_overlap_violations(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 10).alias("a"), (F.col("turn") * 10 + F.length("text") % 25).alias("b"))
    before = F.lag("b").over(Window.partitionBy("conv_id").orderBy("a", "b"))
    return rows.withColumn("before", before).where("a < before").select("conv_id", "turn")


#: Gold and predicted sets from the extracted spans, by rule.
SIDES = "p as (select * from spans where start % 11 <> 2), g as (select * from spans where start % 7 <> 1)"
PRF = "case when p > 0 then c / p::double else 0 end as pr, case when g > 0 then c / g::double else 0 end as re"


def _prf(keys: str, by: str = "") -> str:
    by_ = f"{by}, " if by else ""
    return (
        f"e as (select {keys}, max(x) as x, max(y) as y from (select {keys}, 1 as x, 0 as y from p union all select {keys}, 0, 1 from g) group by all), "
        f"n as (select {by_}coalesce(sum(x), 0)::bigint as p, coalesce(sum(y), 0)::bigint as g, coalesce(sum(x * y), 0)::bigint as c from e {'group by ' + by if by else ''}), m as (select *, {PRF} from n) "
        f"select {by_}p as predicted, g as reference, c as correct, round_even(pr, 6) as precision, round_even(re, 6) as recall, round_even(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 6) as f1 from m"
    )


def sides(spark, d):
    rows = spans(spark, d)
    return rows.where("start % 11 <> 2"), rows.where("start % 7 <> 1")


@register("span_prf1", f"with {fx.SPANS_SQL}, {SIDES}, {_prf('record_id, start, stop, label')}")
def span_prf1(spark, d):
    return E.metrics(*sides(spark, d), E.SPAN)


@register("span_prf1_per_label", f"with {fx.SPANS_SQL}, {SIDES}, {_prf('record_id, start, stop, label', 'label')}")
def span_prf1_per_label(spark, d):
    return E.metrics(*sides(spark, d), E.SPAN, ["label"])


@register("slice_scores", f"with {fx.SPANS_SQL}, sv as (select s.*, vendor from spans s join reports using (record_id)), p as (select * from sv where start % 11 <> 2), g as (select * from sv where start % 7 <> 1), {_prf('record_id, vendor, start, stop, label', 'vendor')}")
def slice_scores(spark, d):
    return E.metrics(*sides(spark, d), [*E.SPAN, "vendor"], ["vendor"])


@register("joint_assertion_prf1", f"with {fx.SPANS_SQL}, {CORRECTED}, p as (select * from spans where label = 'DEFECT'), g as (select * from corrected where label = 'DEFECT'), {_prf('record_id, start, stop, label, assertion')}")
def joint_assertion_prf1(spark, d):
    rows = spans(spark, d).where("label = 'DEFECT'")
    return E.metrics(rows, corrected(rows), [*E.SPAN, "assertion"])


@register("assertion_confusion", f"with {fx.SPANS_SQL}, {CORRECTED} select c.assertion as actual, s.assertion as predicted, count(*) as count from corrected c join spans s using (record_id, start, stop, label) where label = 'DEFECT' group by all")
def assertion_confusion(spark, d):
    rows = spans(spark, d).where("label = 'DEFECT'")
    return E.confusion(corrected(rows), rows)


@register("missed_review_routed", f"with {fx.FINDINGS_SQL}{fx.CANDIDATES_SQL}, lost as (select distinct record_id, start, stop from spans where label = 'DEFECT' and start % 3 = 0) select count(*) as missed_defects, count(*) filter (r) as routed, case when count(*) > 0 then round_even(count(*) filter (r) / count(*), 6) end as coverage from (select exists (select 1 from candidates c where c.record_id = l.record_id and c.start < l.stop and c.stop > l.start - 40) as r from lost l)")
def missed_review_routed(spark, d):
    """Review candidates are widened by 40 characters, so that some meet a missed defect of the clause before."""
    found = fx.extracted(spark, d)
    near = T.unfold(found, "review_candidates", "c", "record_id").select("record_id", "c.start", (F.col("c.stop") + 40).alias("stop"))
    rows = spans(spark, d)
    return E.missed(rows, rows.where("not (label = 'DEFECT' and start % 3 = 0)"), near)


@register("relation_prf1", f"with {fx.FINDINGS_SQL}, p as (select record_id, defect_start, label, start, stop from links), g as (select record_id, defect_start, label, start, stop from links where start % 5 <> 0), {_prf('record_id, defect_start, label, start, stop')}")
def relation_prf1(spark, d):
    rows = T.unfold(fx.extracted(spark, d), "findings", "f", "record_id").select("record_id", F.col("f.defect.start").alias("defect_start"), F.explode("f.links").alias("e")).select("record_id", "defect_start", "e.label", "e.start", "e.stop")
    return E.metrics(rows, rows.where("start % 5 <> 0"), ["record_id", "defect_start", "label", "start", "stop"])


@register("threshold_calibration", f"with {fx.SPANS_SQL}, t as (select unnest([0.5, 0.75, 0.95])::double as threshold), p as (select s.*, threshold from spans s, t where confidence >= threshold and start % 11 <> 2), g as (select s.*, threshold from spans s, t where start % 7 <> 1), {_prf('record_id, start, stop, label, threshold', 'threshold')}")
def threshold_calibration(spark, d):
    return E.calibrate(*sides(spark, d), [0.5, 0.75, 0.95])


RULE = "case when n_chars < 300 then 0 when doc_id % 9 = 0 then 2 else 1 end"


@register("class_report", f"with r as (select quality as a, {RULE} as p from labels join documents using (doc_id)), l as (select a as label from r union select p from r), n as (select label, count(*) filter (a = label) as s, count(*) filter (p = label) as k, count(*) filter (a = label and p = label) as h from l, r group by label), m as (select *, case when k > 0 then h / k else 0 end::double as pr, case when s > 0 then h / s else 0 end::double as re from n) select label, s as support, round_even(pr, 6) as precision, round_even(re, 6) as recall, round_even(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 6) as f1 from m")
def class_report(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return E.class_report(rows.select(F.col("quality").alias("actual"), F.expr(RULE).alias("predicted")))


@register("macro_weighted_f1", f"with r as (select quality as a, {RULE} as p from labels join documents using (doc_id)), l as (select a as label from r union select p from r), n as (select label, count(*) filter (a = label) as s, count(*) filter (p = label) as k, count(*) filter (a = label and p = label) as h from l, r group by label), f as (select s, round_even(case when h > 0 then 2.0::double * (h / k) * (h / s) / (h / k + h / s) else 0 end, 6) as f1 from n) select round_even(avg(f1), 6) as macro_f1, round_even(sum(f1 * s) / sum(s), 6) as weighted_f1 from f")
def macro_weighted_f1(spark, d):
    return E.macro_weighted(class_report(spark, d))


_ITEM = "'{\"text\":\"' || l.text || '\",\"start\":' || l.start || ',\"stop\":' || l.stop || ',\"assertion\":\"' || s.assertion || '\",\"confidence\":' || s.confidence || ',\"method\":\"' || s.method || '\"}'"
_CSV = f"""with {fx.FINDINGS_SQL}{fx.CANDIDATES_SQL},
items as materialized (select l.record_id, l.defect_start, string_agg('\"' || l.label || '\":[' || {_ITEM} || ']', ',' order by l.label) as js from links l join spans s on s.record_id = l.record_id and s.start = l.start and s.label = l.label group by all),
hit as materialized (select record_id, start, stop, 'DEFECT' as label, finding_id, category, priority, reasons, start as ds from findings union all select l.record_id, l.start, l.stop, l.label, f.finding_id, f.category, f.priority, f.reasons, f.start from links l join findings f on f.record_id = l.record_id and f.start = l.defect_start),
told as materialized (select h.record_id, h.start, h.label, string_agg(finding_id, '; ' order by finding_id) as finding_ids, string_agg(coalesce(category, 'Uncategorized'), '; ' order by finding_id) as categories, string_agg(priority, '; ' order by finding_id) as priorities, string_agg(reasons, '; ' order by finding_id) as priority_reasons,
  '{{' || string_agg('\"' || finding_id || '\":{{' || coalesce(js, '') || '}}', ',' order by finding_id) || '}}' as linked_evidence from hit h left join items i on i.record_id = h.record_id and i.defect_start = h.ds group by all)
select r.record_id, r.domain, case when r.record_id in (select record_id from spans where label = 'DEFECT') or r.record_id in (select record_id from candidates) then 'review_required' else 'unmapped' end as mapping_status,
  s.label, s.text, s.assertion, s.start::int as start, s.stop::int as "end", s.confidence, s.method, r.report_id, '' as source_document, r.vendor, '' as report_number, coalesce(r.report_date, '') as report_date, '' as product, r.batch, r.asset_id,
  coalesce(r.report_status, 'pending') as workflow, '' as run_id, '' as review_version, '' as extractor_version, 'uncalibrated' as score_kind, coalesce(finding_ids, '') as finding_ids, coalesce(categories, '') as categories, coalesce(priorities, '') as priorities,
  coalesce(priority_reasons, '') as priority_reasons, coalesce(linked_evidence, '{{}}') as linked_evidence, '{{}}' as metadata_provenance, '' as quality_flags, '1' as export_schema_version
from reports r left join spans s using (record_id) left join told t on t.record_id = s.record_id and t.start = s.start and t.label = s.label"""


@register("export_csv_rows", _CSV)
def export_csv_rows(spark, d):
    return O.csv_rows(fx.extracted(spark, d))


@register("spreadsheet_safe", "select page_id, case when regexp_matches(ltrim(v), '^[=+@-]') then '''' || v else v end as cell from (select page_id, case page_id % 4 when 0 then '=' || url when 1 then ' @' || url when 2 then '-' || url else url end as v from pages)")
def spreadsheet_safe(spark, d):
    value = F.expr("case page_id % 4 when 0 then concat('=', url) when 1 then concat(' @', url) when 2 then concat('-', url) else url end")
    return table(spark, d, "pages").select("page_id", T.spreadsheet_safe(value).alias("cell"))


@register("html_escape", "select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as escaped from pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@register("html_highlight", f"with {fx.SPANS_SQL}, o as (select s.*, narrative, lag(stop, 1, 0) over (partition by record_id order by start) as before from spans s join reports using (record_id)), m as (select record_id, string_agg(replace(substr(narrative, before + 1, start - before), '&', '&amp;') || '<mark title=\"' || label || ' · ' || assertion || '\">' || text || '</mark>', '' order by start) as head, max(stop) as tail from o group by record_id) select record_id, coalesce(head, '') || substr(narrative, coalesce(tail, 0) + 1) as html from reports left join m using (record_id)")
def html_highlight(spark, d):
    return fx.spanned(spark, d).select("record_id", O.highlight(F.col("narrative"), F.col("entities")).alias("html"))


@register("relationship_rows", f"with {fx.FINDINGS_SQL} select record_id || ':defect:' || defect_start as finding_id, label, start::int as start, stop::int as stop, text from links")
def relationship_rows(spark, d):
    return O.relationship_rows(fx.extracted(spark, d))


@register("annotation_batch", f"with {fx.REPORTS_SQL} select record_id, narrative from reports where report_id in (select o_orderkey::varchar from orders where o_orderstatus = 'O')")
def annotation_batch(spark, d):
    approved = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").cast("string").alias("report_id"))
    return O.blinded(fx.reports(spark, d), approved, "report_id")
