"""Queries of reading, of human review, of gold gates and of learning, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators import classify, evaluate, review
from gaugeline.operators import extract as X
from gaugeline.plans import fixtures as fx
from gaugeline.plans.catalogue import register
from gaugeline.plans.corpus import CLEAN, NORM
from gaugeline.scratch import materialise, write
from gaugeline.session import spread, table
from gaugeline.sources import quoted, readers


_PAGE_TEXT = r"regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'g'), '<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"


@register("canonical_records", f"select {CLEAN} as narrative, url as report_id, lower(trim(regexp_replace(split_part(url, '/', 3), '\\s+', ' ', 'g'))) as vendor_key, 'B1' as batch from (select {_PAGE_TEXT} as text, url from pages) where trim(text) <> ''")
def canonical_records(spark, d):
    """The whole text of every page, without markup, as a canonical record."""
    text = F.col("html")
    for pattern in ("<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>", "<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    rows = spread(table(spark, d, "pages")).select(text.alias("note"), F.split("url", "/")[2].alias("host"), "url", F.lit("unused").alias("other"))
    out = readers.records(rows, "note", {"vendor": "host", "report_number": "url"}, {"batch": "B1"})
    return out.select("narrative", "report_id", "vendor_key", "batch")


@register("parsed_dates", "select event_id, strftime(ts, '%Y-%m-%d') as report_date from events")
def parsed_dates(spark, d):
    said = F.date_format("ts", "d/M/yyyy")
    return table(spark, d, "events").select("event_id", T.parse_date(said, "d/M/yyyy").alias("report_date"))


@register("source_dialect_rows", f"select doc_id::varchar as source_record_id, {CLEAN} as narrative, {CLEAN} <> {NORM} as sensitive, (case when coalesce(trim(source), '') = '' then 0 else 1 end + case when lang <> 'en' then 1 else 0 end)::int as targets, case when {CLEAN} = '' then 'empty_narrative' else '' end as excluded from documents")
def source_dialect_rows(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("OperatorControlNumber"), F.col("text").alias("Discrepancy"), F.col("source").alias("PartName"), F.when(F.col("lang") != "en", F.col("lang")).otherwise(" ").alias("PartCondition"))
    return readers.source_records(rows, "faa_sdr", "documents.csv").select("source_record_id", "narrative", "sensitive", F.size("structured").alias("targets"), "excluded")


_NOTE = "concat(replace(coalesce(text, ''), chr(13), ' '), chr(10), '\"', lang, '\", ', n_chars)"


@register("quoted_csv_rows", f"select doc_id::varchar as doc_id, lang, length({_NOTE})::int as n_chars, sha256({_NOTE}) as digest, 1 as copies from documents")
def quoted_csv_rows(spark, d):
    """All documents through quoted files whose cells hold line feeds, quotes and separators; copies counts the rows that have one number in one file."""
    told = F.concat(F.translate(F.coalesce("text", F.lit("")), "\r", " "), F.lit('\n"'), "lang", F.lit('", '), F.col("n_chars").cast("string"))
    rows = spread(table(spark, d, "documents")).select("doc_id", "lang", told.alias("note"))
    path = write(rows, "quoted", "csv", header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = quoted.table(spark, path, file="file")
    numbers = got.groupBy("file", "source_row").agg(F.count("*").alias("copies"))
    return got.join(numbers, ["file", "source_row"]).select("doc_id", "lang", F.length("note").alias("n_chars"), F.sha2("note", 256).alias("digest"), F.col("copies").cast("int").alias("copies"))


EDITS = "edits as (select record_id, case when start % 9 = 4 then 'THING' else label end as label, (case when start % 4 = 1 then start - 3 else start end)::int as start, (case when start % 13 = 2 then stop + 500 else stop end)::int as stop, assertion from spans)"


def edits(rows):
    return rows.select("record_id", F.when(F.col("start") % 9 == 4, "THING").otherwise(F.col("label")).alias("label"), F.when(F.col("start") % 4 == 1, F.col("start") - 3).otherwise(F.col("start")).alias("start"), F.when(F.col("start") % 13 == 2, F.col("stop") + 500).otherwise(F.col("stop")).alias("stop"), "assertion")


def spans(spark, d):
    rows = T.unfold(fx.spanned(spark, d), "entities", "e", "record_id")
    return rows.select("record_id", "e.*")


@register("human_span_violations", f"with {fx.SPANS_SQL}, {EDITS}, b as (select e.*, length(narrative) as size, max(stop) over (partition by record_id order by start, stop rows between unbounded preceding and 1 preceding) as before from edits e join reports using (record_id)), v as (select *, case when start < 0 or stop > size or stop <= start then 'out_of_bounds' when label = 'THING' then 'unknown_label' when start < before then 'overlap' end as violation from b) select record_id, start, stop, violation from v where violation is not null")
def human_span_violations(spark, d):
    return review.edit_violations(edits(spans(spark, d)), fx.reports(spark, d))


@register("human_entities", f"with {fx.SPANS_SQL} select record_id, label, text, start::int as start, stop::int as stop, assertion, 1.0::double as confidence, 'human' as method from spans")
def human_entities(spark, d):
    """All spans as edits."""
    return review.human_entities(spans(spark, d).select("record_id", "label", "start", "stop", "assertion"), fx.reports(spark, d))


@register("edited_links", f"with {fx.FINDINGS_SQL}, e as (select record_id || ':defect:' || (defect_start + case when start % 5 = 0 then 1 else 0 end) as finding_id, record_id, label, start, stop from links), v as (select distinct e.finding_id, e.label, e.start, e.stop from e join findings f using (finding_id) join spans s on s.record_id = e.record_id and s.label = e.label and s.start = e.start and s.stop = e.stop) select finding_id, label, start::int as start, stop::int as stop, 'valid' as status from v union all select finding_id, label, start, stop, 'violation' from e where not exists (select 1 from v where v.finding_id = e.finding_id and v.label = e.label and v.start = e.start and v.stop = e.stop)")
def edited_links(spark, d):
    found = fx.extracted(spark, d)
    long = T.unfold(found, "findings", "f", "record_id").select("record_id", "f.finding_id", F.col("f.defect.start").alias("at"), F.explode("f.links").alias("e"))
    asked = long.select(F.concat_ws(":defect:", "record_id", (F.col("at") + F.when(F.col("e.start") % 5 == 0, 1).otherwise(0)).cast("string")).alias("finding_id"), "record_id", "e.label", "e.start", "e.stop")
    links, wrong = review.edited_links(asked, spans(spark, d), T.unfold(found, "findings.finding_id", "finding_id"))
    columns = ["finding_id", "label", "start", "stop"]
    return links.select(*columns, F.lit("valid").alias("status")).unionByName(wrong.select(*columns, F.lit("violation").alias("status")))


GOLD = "select doc_id::varchar as record_id, doc_id % 7 <> 0 as privacy_reviewed, case when doc_id % 5 = 0 then 'model' else 'human' end as annotation_source, case when doc_id % 3 = 0 then 'draft' else 'adjudicated' end as annotation_status"


@register("gold_gates", "select record_id, array_to_string(list_filter([case when i % 7 = 0 then 'privacy_not_reviewed' end, case when i % 5 = 0 then 'source_not_human' end, case when i % 3 = 0 then 'not_adjudicated' end, case when i % 11 = 0 then 'too_few_annotators' end, case when i % 13 = 0 then 'no_adjudicator' end, case when i % 17 = 0 then 'no_version' end], lambda x: x is not null), '; ') as reasons from (select doc_id::varchar as record_id, doc_id as i from documents) where i % 7 = 0 or i % 5 = 0 or i % 3 = 0 or i % 11 = 0 or i % 13 = 0 or i % 17 = 0")
def gold_gates(spark, d):
    i = F.col("doc_id")
    gold = table(spark, d, "documents").select(
        i.cast("string").alias("record_id"), (i % 7 != 0).alias("privacy_reviewed"), F.when(i % 5 == 0, "model").otherwise("human").alias("annotation_source"), F.when(i % 3 == 0, "draft").otherwise("adjudicated").alias("annotation_status"),
        F.when(i % 11 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("annotator_ids"), F.when(i % 13 != 0, "c").alias("adjudicator_id"), F.when(i % 17 != 0, "v1").alias("annotation_version"),
    )
    return review.gold_gates(gold).select("record_id", F.array_join("reasons", "; ").alias("reasons"))


@register("hybrid_merge", f"with {fx.SPANS_SQL}, w as (select record_id, regexp_extract(narrative, '^[A-Za-z]+') as text from reports) select record_id, label, text, start::int as start, stop::int as stop, confidence, method from spans where confidence >= 0.75 union all select record_id, 'COMPONENT', text, 0, length(text)::int, 0.5, 'ner' from w where not exists (select 1 from spans s where s.record_id = w.record_id and s.start < length(w.text))")
def hybrid_merge(spark, d):
    """Rule spans with those of a tagger, here one that tags the first word."""
    text = F.col("narrative")
    rows = fx.spanned(spark, d)
    tagged = review.tagged_spans(text, T.find_spans(text, "^[A-Za-z]+"), "COMPONENT")
    out = T.unfold(rows, review.hybrid(F.col("entities"), tagged, 0.75), "e", "record_id")
    return out.select("record_id", *[F.col(f"e.{c}").alias(c) for c in ("label", "text", "start", "stop", "confidence", "method")])


@register("token_alignment", f"with {fx.SPANS_SQL} select record_id, start::int as start, stop::int as stop, start % 4 <> 3 as aligned from spans where label = 'DEFECT'")
def token_alignment(spark, d):
    """Spans cut by a character are not aligned with words."""
    rows = spans(spark, d).where("label = 'DEFECT'").join(fx.reports(spark, d).select("record_id", "narrative"), "record_id")
    cut = F.when(F.col("start") % 4 == 3, F.col("start") + 1).otherwise(F.col("start"))
    return rows.select("record_id", "start", "stop", review.aligned(F.col("narrative"), cut, F.col("stop")).alias("aligned"))


_VENDORED = "reports as materialized (select * replace (case when length(narrative) % 3 = 0 then 'Supplier ' || vendor || ' says: ' || narrative else narrative end as narrative, case when length(narrative) % 4 = 0 then 'cracked' else vendor end as vendor) from plain_reports)"
_SHOWN = fx.SPANS_SQL.replace("reports as materialized (", "plain_reports as materialized (", 1).replace(",\ntexts as", f", {_VENDORED},\ntexts as", 1)


@register("perturbation_invariance", f"with {_SHOWN}, hit as (select distinct record_id from reports where contains(lower(narrative), lower(vendor))), lost as (select distinct s.record_id from spans s join reports r using (record_id) where vendor = 'cracked' and lower(s.text) = 'cracked' and s.record_id in (select record_id from hit)) select 'metadata' as kind, (select count(*) from reports) as reports, 0::bigint as changed union all select 'spaces', (select count(*) from reports), 0 union all select 'text', (select count(*) from hit), (select count(*) from lost)")
def perturbation_invariance(spark, d):
    """Another vendor in the metadata, double spaces, and another vendor in the text.

    In some reports the vendor is named in the text; in some it has the name of a defect,
    and replacing that does change what is extracted.
    """
    rows = fx.reports(spark, d)
    n = F.length("narrative")
    told = F.when(n % 3 == 0, F.concat(F.lit("Supplier "), "vendor", F.lit(" says: "), "narrative")).otherwise(F.col("narrative"))
    return perturbed(rows.withColumns({"narrative": told, "vendor": F.when(n % 4 == 0, F.lit("cracked")).otherwise(F.col("vendor"))}))


def perturbed(rows):
    """(kind, reports, changed) of three perturbations of reports; texts are collapsed before extraction, vendors replaced where they stand.

    Extraction is handed a text and a domain and nothing else, so what a perturbation leaves as it
    is can't extract otherwise: each pair of unlike texts is extracted once, however many reports
    have it, and the two stay beside each other.
    """
    named = (F.length("vendor") > 0) & F.contains(F.lower("narrative"), F.lower("vendor"))
    swapped = F.regexp_replace("narrative", F.concat(F.lit(r"(?i)\Q"), F.col("vendor"), F.lit(r"\E")), F.lit("Unseen Vendor"))
    wide = F.regexp_replace("narrative", r"[ \t]+", "  ")
    collapsed = lambda text: F.trim(F.regexp_replace(text, r"\s+", " "))
    kinds = {"metadata": (F.lit(True), F.col("narrative")), "spaces": (F.lit(True), collapsed(wide)), "text": (named, collapsed(swapped))}
    tried = rows.agg(F.count("*").alias("metadata"), F.count("*").alias("spaces"), F.count_if(named).alias("text"))
    tried = tried.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("reports")) for kind in kinds])).alias("k")).select("k.*")
    after = F.array(*[F.struct(F.lit(kind).alias("kind"), F.when(some, text).alias("after")) for kind, (some, text) in kinds.items()])
    pair = ["kind", "narrative", "after", "domain"]
    pairs = rows.select("narrative", "domain", F.explode(after).alias("k")).select("narrative", "domain", "k.*").where("after <> narrative").groupBy(*pair).agg(F.count("*").alias("n"))
    texts = pairs.select(*pair, "n", F.explode(F.array("narrative", "after")).alias("text"))
    said = X.extract(texts, packs=[fx.PARTS], text_col="text").select(*pair, "n", F.to_json(review.signature(F.col("entities"))).alias("said"))
    wrong = said.groupBy(*pair, "n").agg(F.min("said").alias("one"), F.max("said").alias("other")).where("one <> other").groupBy("kind").agg(F.sum("n").alias("changed"))
    return tried.join(wrong, "kind", "left").select("kind", "reports", F.coalesce("changed", F.lit(0)).alias("changed"))


@register("extraction_comparison", f"with {fx.SPANS_SQL}, g as (select * from lexicon where scope = 'all' and label <> 'COMPONENT') select 'adapted' as mode, label, count(*) as spans from spans group by label union all select 'generic', label, count(*) from spans s where label <> 'COMPONENT' group by label")
def extraction_comparison(spark, d):
    """The same reports with and without the component pack, as one tagged union."""
    def both(rows):
        generic = X.extract(rows).select(*rows.columns, F.col("entities").alias("generic"))
        return X.extract(generic, packs=[fx.PARTS])

    named = [F.transform(f"{c}.label", _mode(m)) for m, c in (("adapted", "entities"), ("generic", "generic"))]
    rows = T.unfold(X.once_a_text(fx.reports(spark, d), both), F.concat(*named), "e")
    return rows.groupBy("e.mode", "e.label").agg(F.count("*").alias("spans"))


def _mode(name):
    return lambda label: F.struct(F.lit(name).alias("mode"), label.alias("label"))


@register("extraction_failures", f"with {fx.REPORTS_SQL} select mode, record_id, case when mode = 'parts' and contains(narrative, 'flensing') then 'ValueError: flensing' end as failure, case when mode = 'parts' and not contains(narrative, 'flensing') then len(regexp_extract_all(narrative, '\\b(?:anvil|widget|ring|bolt|gear|gizmo|plate|rod|housing)\\b')) else 0 end::int as spans from reports, (select unnest(['parts', 'none']) as mode)")
def extraction_failures(spark, d):
    """Two extractors over all reports; one of them fails on a word, and only the reports that have it are lost to it."""
    return evaluate.compared(fx.reports(spark, d), {"parts": part_words, "none": lambda texts: [[] for _ in texts]}).select("mode", "record_id", "failure", F.size("spans").alias("spans"))


def part_words(texts):
    import re

    if any("flensing" in t for t in texts):
        raise ValueError("flensing")
    words = re.compile(r"\b(?:" + "|".join(fx.PARTS["COMPONENT"]) + r")\b")
    return [[(m.start(), m.end(), "COMPONENT") for m in words.finditer(t)] for t in texts]


@register("induced_terms", f"with {fx.SPANS_SQL} select lower(text) as term, label, count(*) as n from spans where label <> 'MEASUREMENT' group by all having count(*) >= 2")
def induced_terms(spark, d):
    return review.terms_seen(spans(spark, d).where("label <> 'MEASUREMENT'"))


_TERMS_SQL = r"""low as materialized (select doc_id, lower(coalesce(text, '')) as t from documents),
words as materialized (select doc_id, regexp_extract_all(t, '[\p{L}\p{N}_]{2,}') as a from low),
padded as materialized (select doc_id, ' ' || unnest(string_split_regex(t, '[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+')) || ' ' as p from low),
terms as (select doc_id, 'word' as kind, unnest(a) as term from words union all select doc_id, 'word', unnest(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) from words),
grams as (select doc_id, 'character' as kind, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) as term from padded where p <> '  '
  union all select doc_id, 'character', unnest(list_transform(range(1, length(p) - 2), lambda i: substr(p, i, 4))) from padded where length(p) > 3
  union all select doc_id, 'character', unnest(list_transform(range(1, length(p) - 3), lambda i: substr(p, i, 5))) from padded where length(p) > 4)"""


@register("tfidf_terms", f"with {_TERMS_SQL}, every as (select * from terms union all select * from grams) select kind, term, count(distinct doc_id) as df, count(*) as tf, round(ln((1 + (select count(*) from documents)) / (1 + count(distinct doc_id))::double) + 1, 9) as idf from every group by kind, term")
def tfidf_terms(spark, d):
    """All words, pairs and characters of all documents with their frequencies."""
    docs = spread(table(spark, d, "documents"))
    return classify.vocabulary(classify.term_counts(docs, "doc_id"), docs.count()).select("kind", "term", "df", "tf", F.round("idf", 9).alias("idf"))


@register("tfidf_weights", f"with {_TERMS_SQL}, tf as (select doc_id, term, count(*) as tf from terms group by all), df as (select term, count(*) as df from tf group by term), w as (select doc_id, term, (1 + ln(tf)) * (ln((1 + (select count(*) from documents)) / (1 + df)::double) + 1) as w from tf join df using (term)), n as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id) select doc_id, term, round(w / norm, 7) as weight from w join n using (doc_id)")
def tfidf_weights(spark, d):
    """The weight of every word and pair in every document."""
    docs = spread(table(spark, d, "documents"))
    counts = materialise(classify.term_counts(docs, "doc_id", characters=False), "tfidf-counts")
    rows = classify.weights(counts, classify.vocabulary(counts, docs.count()))
    return rows.select(F.col("id").alias("doc_id"), F.explode("features").alias("f")).select("doc_id", "f.term", F.round("f.weight", 7).alias("weight"))


@register("tfidf_logreg_metrics")
def tfidf_logreg_metrics(spark, d):
    """Train six candidates on documents whose hash says so, choose on validation, report on test."""
    from gaugeline.operators.corpus import grouped_split

    labels = table(spark, d, "labels").select("doc_id", F.concat(F.lit("quality "), "quality").alias("label"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = docs.join(labels, "doc_id").withColumn("split", grouped_split(F.col("doc_id").cast("string"), "gaugeline-v1"))
    part = {s: rows.where(F.col("split") == s).select("text", "label") for s in ("train", "validation", "test")}
    scores, _, _ = classify.select_and_score(part["train"], part["validation"], part["test"])
    return scores
