"""Queries of grouping, split policies, partition modes, quotas and split loaders over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators import corpus as C
from gaugeline.operators import partition as P
from gaugeline.operators.review import LABELS
from gaugeline.plans import corpus as pc
from gaugeline.plans.catalogue import register
from gaugeline.session import table

DOMAINS = ("construction", "aviation", "pipeline")
_YEAR = "(2009 + i // 10 % 19)"
#: Records of a corpus: every fifth document names an event, which it shares with another; periods and supplied splits follow from ids.
RECORDS = f"""
keys as materialized (select doc_id as i, doc_id::varchar as record_id, text, source, lang, n_chars, {pc.EXACT} as exact, case when len(w) >= 8 then sha256(array_to_string(w, ' ')) end as template from (select *, {pc._TEMPLATE} as w from documents)),
records as materialized (select k.i, k.record_id, source, lang, exact, template, case when i % 5 = 0 then 'SDR-' || {_YEAR} || '-' || (i // 10) end as event, {list(DOMAINS)}[1 + i % 3] as domain,
  {_YEAR}::int as year, ['train', 'validation', 'test'][1 + i // 4 % 3] as official, case when n_chars < 100 then 'short' else '' end as excluded, sha256('sample-v1:' || i) as sample_rank,
  coalesce('q' || quality || 't' || toxic, '') as label from keys k left join labels l on l.doc_id = k.i)
"""
EDGES = ", long as materialized (select record_id, 'e' || event as k from records where event is not null union all select record_id, 'x' || exact from records where exact <> '' union all select record_id, 't' || template from records where template is not null)"
GROUPED = """, firsts as materialized (select record_id, k, min(record_id) over (partition by k) as f from long), e as materialized (select distinct record_id as a, f as b from firsts where record_id <> f union select distinct f, record_id from firsts where record_id <> f),
walk as (select record_id as a, record_id as b from records union select w.a, e.b from walk w join e on w.b = e.a), grouped as materialized (select a as record_id, min(b) as group_id from walk group by a)
"""
_PERIOD = "case when year = 2026 then 'demo' when year = 2025 then 'test' when year = 2024 then 'validation' when year between 2010 and 2023 then 'train' else 'quarantine' end"
POLICIES = f""", known as (select group_id, min({_PERIOD}) filter (domain = 'aviation') as p1, max({_PERIOD}) filter (domain = 'aviation') as p2, min(official) filter (domain = 'construction') as o1, max(official) filter (domain = 'construction') as o2,
  {pc.UNIT.format(f"'{pc.SEED}:' || group_id")} as u from records join grouped using (record_id) group by group_id),
assigned as materialized (select r.*, group_id, case when excluded <> '' then 'excluded' when year = 2026 then 'demo' when u < 0.7 then 'train' when u < 0.85 then 'validation' else 'test' end as grouped,
  case when excluded <> '' then 'excluded' when domain <> 'aviation' then 'not_applicable' when p1 = p2 then p1 else 'quarantine' end as temporal,
  case when excluded <> '' then 'excluded' when domain <> 'construction' then 'not_applicable' when o1 = o2 then o1 else 'quarantine' end as official_safe from records r join grouped using (record_id) join known using (group_id))
"""
ASSIGNED = f"recursive {RECORDS}{EDGES}{GROUPED}{POLICIES}"


def records(spark, d):
    i = F.col("doc_id")
    docs = pc.docs(spark, d).select(
        i, i.cast("string").alias("record_id"), "source", "lang", T.exact_key(F.col("text")).alias("exact"), T.template_key(F.col("text")).alias("template"),
        F.expr("case when doc_id % 5 = 0 then concat('SDR-', 2009 + doc_id div 10 % 19, '-', doc_id div 10) end").alias("event"),
        F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), (i % 3 + 1).cast("int")).alias("domain"), F.expr("cast(2009 + doc_id div 10 % 19 as int)").alias("year"),
        F.element_at(F.array(*[F.lit(x) for x in C.SPLITS]), F.expr("cast(doc_id div 4 % 3 + 1 as int)")).alias("official"), F.when(F.col("n_chars") < 100, "short").otherwise("").alias("excluded"), C.sample_rank(i.cast("string")).alias("sample_rank"),
    )
    labels = table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("label"))
    return docs.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(""))).drop("doc_id")


def assigned(spark, d):
    return P.policies(records(spark, d), pc.SEED)


@register("event_years", f"with {RECORDS} select record_id, nullif(regexp_extract(event, 'SDR-([0-9]{{4}})', 1), '')::int as year from records")
def event_years(spark, d):
    return records(spark, d).select("record_id", P.event_year(F.col("event")).alias("year"))


@register("split_policies", f"with {ASSIGNED} select record_id, group_id, grouped, temporal, official_safe from assigned")
def split_policies(spark, d):
    """Groups over events, equal texts and templates, and the three policies of their splits."""
    return assigned(spark, d).select("record_id", "group_id", "grouped", "temporal", "official_safe")


@register("hold_outs", f"with {ASSIGNED}, n as (select group_id, list(distinct domain) as ds from assigned group by group_id) select record_id, " + ", ".join(f"case when grouped in ('demo', 'excluded') then grouped when list_contains(ds, '{x}') then 'test' when grouped = 'train' then 'train' else 'validation' end as holdout_{x}" for x in DOMAINS) + " from assigned join n using (group_id)")
def hold_outs(spark, d):
    return P.hold_outs(assigned(spark, d)).select("record_id", *[f"holdout_{x}" for x in DOMAINS])


@register("domain_split_choice", f"with {ASSIGNED} select domain, case domain when 'construction' then official_safe when 'aviation' then temporal else grouped end as split, count(*) as n from assigned group by all")
def domain_split_choice(spark, d):
    split = P.domain_choice(F.col("domain"), F.col("temporal"), F.col("official_safe"), F.col("grouped"))
    return assigned(spark, d).groupBy("domain", split.alias("split")).agg(F.count("*").alias("n"))


@register("policy_audit", f"with {ASSIGNED}, l as (select group_id, 'grouped' as policy, grouped as s from assigned union all select group_id, 'temporal', temporal from assigned union all select group_id, 'official_safe', official_safe from assigned union all select group_id, 'supplied', official from assigned), g as (select policy, group_id, count(distinct s) as n from l where s in ('train', 'validation', 'test') group by all) select policy, count(*) filter (n > 1) as leaking_groups from g group by policy")
def policy_audit(spark, d):
    """Groups that stand in several splits, by policy; the supplied split knows nothing of groups and leaks."""
    pairs = F.array(*[F.struct(F.lit(n).alias("policy"), F.col(c).alias("s")) for n, c in (("grouped", "grouped"), ("temporal", "temporal"), ("official_safe", "official_safe"), ("supplied", "official"))])
    rows = assigned(spark, d).select("group_id", F.explode(pairs).alias("p")).select("group_id", "p.policy", "p.s").where(F.col("s").isin(*C.SPLITS))
    return rows.groupBy("policy", "group_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).groupBy("policy").agg(F.count_if(F.col("lo") != F.col("hi")).alias("leaking_groups"))


@register("domain_distributions", f"with {ASSIGNED} select domain, 'label' as \"column\", label as value, count(*) as n from assigned group by all union all " + " union all ".join(f"select domain, '{c}', {c}::varchar, count(*) from assigned group by all" for c in ("year", "excluded", "grouped", "temporal", "official_safe", "official", "lang")))
def domain_distributions(spark, d):
    """Eight columns by domain: each record is exploded into (column, value) pairs and counted in one pass."""
    columns = ("label", "year", "excluded", "grouped", "temporal", "official_safe", "official", "lang")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return assigned(spark, d).select("domain", F.explode(pairs).alias("p")).groupBy("domain", "p.column", "p.value").agg(F.count("*").alias("n"))


@register("domain_analytics", f"with {ASSIGNED}, s as (select *, case domain when 'construction' then official_safe when 'aviation' then temporal else grouped end as split, {pc.RISKS} <> [] as pii, len(list_filter(string_split(t, ' '), lambda x: x <> ''))::int as words from (select a.*, {pc.NORM} as t, {pc.CLEAN} as r from assigned a join documents on doc_id = i)) select domain, count(*) as records, count(*) filter (excluded <> '') as excluded, count(*) filter (pii) as pii_flagged, round_even(avg(words), 2) as mean_words, count(distinct group_id) as groups, " + ", ".join(f"count(*) filter (split = '{x}') as {x}" for x in ("train", "validation", "test", "quarantine", "demo")) + ", count(*) filter (label = '') as unlabelled from s group by domain")
def domain_analytics(spark, d):
    """A domain's records, exclusions, flags, words, groups and splits in one aggregation."""
    told = pc.docs(spark, d).select(F.col("doc_id").cast("string").alias("record_id"), T.token_count(F.col("text")).alias("words"), (F.size(T.risks(T.collapse(F.coalesce("text", F.lit(""))))) > 0).alias("pii"))
    rows = assigned(spark, d).withColumn("split", P.domain_choice(F.col("domain"), F.col("temporal"), F.col("official_safe"), F.col("grouped"))).join(told, "record_id")
    return rows.groupBy("domain").agg(
        F.count("*").alias("records"), F.count_if(F.col("excluded") != "").alias("excluded"), F.count_if("pii").alias("pii_flagged"), F.bround(F.avg("words"), 2).alias("mean_words"), F.count_distinct("group_id").alias("groups"),
        *[F.count_if(F.col("split") == x).alias(x) for x in ("train", "validation", "test", "quarantine", "demo")], F.count_if(F.col("label") == "").alias("unlabelled"),
    )


_SELECTED = "(label <> '' and sample_rank < '8')"


@register("domain_split_loader", f"with {ASSIGNED}, c as (select group_id from assigned where domain = 'pipeline' and label <> '' group by group_id having count(distinct label) > 1) select record_id, label, 'train' as split from assigned where domain = 'pipeline' and {_SELECTED} and label in ('q1t0', 'q0t0') union all select min(record_id), min(label), min(grouped) from assigned where domain = 'pipeline' and grouped in ('validation', 'test') and excluded = '' and label in ('q1t0', 'q0t0') and group_id not in (select group_id from c) group by group_id")
def domain_split_loader(spark, d):
    """Selected records train; one record of each group without a conflict validates or tests."""
    return P.load_splits(assigned(spark, d).withColumn("selected", F.expr(_SELECTED)), "pipeline", "grouped", ["q1t0", "q0t0"])


@register("safe_split_loader", f"with {ASSIGNED} select record_id, label, official_safe as split, {pc.NORM} as clean_text from assigned join documents on doc_id = i where domain = 'construction' and official_safe in ('train', 'validation', 'test') and label <> '' and {pc.NORM} <> ''")
def safe_split_loader(spark, d):
    rows = assigned(spark, d)
    texts = pc.docs(spark, d).select(F.col("doc_id").cast("string").alias("record_id"), T.collapse(F.coalesce("text", F.lit(""))).alias("clean_text"))
    cleaned = texts.join(rows.select("record_id", "domain", F.concat(F.lit(" "), "label").alias("label")), "record_id")
    return P.load_safe_splits(cleaned, rows.select("record_id", "domain", "official_safe"))


_QUOTA = {"construction": 7, "aviation": 9, "pipeline": 5}
_QUOTAS = ", ".join(f"('{k}', {v})" for k, v in _QUOTA.items())
_PICKED = f"""q(domain, quota) as (values {_QUOTAS}), pool as (select record_id, domain, label, sample_rank from records where label <> ''),
l as (select domain, label, quota, count(*) over (partition by domain) as n, row_number() over (partition by domain order by label) as place from (select distinct domain, label from pool) join q using (domain)),
k as (select p.*, quota, row_number() over (partition by p.domain, p.label order by sample_rank, record_id) <= quota // n + case when place <= quota % n then 1 else 0 end as first from pool p join l on l.domain = p.domain and l.label = p.label),
picked as materialized (select record_id, domain, label, sample_rank from (select *, row_number() over (partition by domain order by first desc, sample_rank, label, record_id) as nth from k) where nth <= quota)"""


def quota_rows(spark, d):
    pool = records(spark, d).where("label <> ''").select("record_id", "domain", "label", "sample_rank")
    quotas = spark.createDataFrame(list(_QUOTA.items()), "domain string, quota long")
    return pool, P.quota_with_refill(pool, quotas, ["domain"])


@register("quota_with_refill", f"with {RECORDS}, {_PICKED} select record_id, domain, label from picked")
def quota_with_refill(spark, d):
    return quota_rows(spark, d)[1].select("record_id", "domain", "label")


@register("risky_replaced", f"with {RECORDS}, {_PICKED}, risky as (select record_id from pool where sample_rank < '3'), need as (select domain, count(*) as needed from picked where record_id in (select record_id from risky) group by domain), spare as (select p.*, row_number() over (partition by domain order by sample_rank, record_id) as nth from pool p where record_id not in (select record_id from picked) and record_id not in (select record_id from risky)) select record_id, domain from picked where record_id not in (select record_id from risky) union all select record_id, domain from spare join need using (domain) where nth <= needed")
def risky_replaced(spark, d):
    """Selected records that detectors flag are replaced by the next safe ones of their stratum; here ranks stand for flags."""
    pool, picked = quota_rows(spark, d)
    return P.swap_risky(picked, pool, pool.where("sample_rank < '3'").select("record_id"), ["domain"]).select("record_id", "domain")


@register("running_index", "select doc_id, row_number() over (order by source, doc_id) - 1 as idx from documents where source is not null")
def running_index(spark, d):
    return P.running_index(table(spark, d, "documents").where("source is not null").select("doc_id", "source"), "source", "doc_id").select("doc_id", "idx")


@register("pilot_audit", f"with r as (select *, {pc.CLEAN} <> {pc.NORM} as sensitive, {pc.NORM} = '' as empty from documents), l as (select 'domain' as \"column\", lang as value, sensitive, empty from r union all select 'split', ['train', 'validation', 'test'][1 + doc_id % 3], sensitive, empty from r union all select 'file', source, sensitive, empty from r) select \"column\", value, count(*) as records, count(*) filter (sensitive) as redacted, count(*) filter (empty) as excluded from l group by all")
def pilot_audit(spark, d):
    found = pc.docs(spark, d).select("doc_id", "lang", "source", T.prepare(F.coalesce("text", F.lit(""))).alias("c"))
    split = F.element_at(F.array(*[F.lit(x) for x in C.SPLITS]), (F.col("doc_id") % 3 + 1).cast("int"))
    return P.pilot_audit(found.select(F.col("lang").alias("domain"), split.alias("split"), F.col("source").alias("file"), F.col("c.sensitive").alias("sensitive"), F.when(F.col("c.text") == "", "empty").otherwise("").alias("excluded")))


#: Reports over documents: an event every fourth document, vendors by source, dates by id.
REPORTS = f"""
reports as materialized (select doc_id::varchar as record_id, case when doc_id % 4 = 0 then 'E' || (doc_id // 8) end as event, case when doc_id % 6 = 0 then 'R' || (doc_id // 12) else '' end as report_id, source as vendor, {list(DOMAINS)}[1 + doc_id % 3] as domain,
  case when doc_id % 10 = 0 then null else '200' || (doc_id % 10) || '-01-01' end as report_date,
  sha256(array_to_string(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[0-9]+(?:[.][0-9]+)?', '<number>', 'g'), '[\\p{{L}}\\p{{N}}_\\p{{M}}]+|<number>'), ' ')) as template from documents)
"""
_PAIRS = pc._JACCARD + ", near as materialized (select a, b from c where common / (na + nb - common)::double >= 0.9)"
_KEYS = "select record_id, 'e' || event as k from reports where event is not null union all select record_id, 'r' || coalesce(nullif(report_id, ''), event) from reports where coalesce(nullif(report_id, ''), event) is not null union all select record_id, 't' || template from reports"


def _connected(vendor: bool) -> str:
    more = " union all select record_id, 'v' || lower(vendor) from reports where vendor <> ''" if vendor else ""
    return f"""recursive {REPORTS}, {_PAIRS}, long as materialized ({_KEYS}{more}), firsts as materialized (select record_id, min(record_id) over (partition by k) as f from long),
e as materialized (select distinct record_id as a, f as b from firsts where record_id <> f union select distinct f, record_id from firsts where record_id <> f union select a, b from near union select b, a from near),
walk as (select record_id as a, record_id as b from reports union select w.a, e.b from walk w join e on w.b = e.a), members as materialized (select a as record_id, min(b) as group_id from walk group by a)"""


def reports(spark, d):
    return pc.docs(spark, d).select(
        F.col("doc_id").cast("string").alias("record_id"), F.expr("case when doc_id % 4 = 0 then concat('E', doc_id div 8) end").alias("event"), F.expr("case when doc_id % 6 = 0 then concat('R', doc_id div 12) else '' end").alias("report_id"),
        F.col("source").alias("vendor"), F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), (F.col("doc_id") % 3 + 1).cast("int")).alias("domain"),
        F.expr("case when doc_id % 10 = 0 then null else concat('200', doc_id % 10, '-01-01') end").alias("report_date"), F.coalesce("text", F.lit("")).alias("narrative"),
    )


_U8 = pc.UNIT.format("'generalisation-v1:' || min(record_id)")


@register("connected_reports", f"with {_connected(False)} select record_id, group_id from members")
def connected_reports(spark, d):
    """Connected over event, report, template and nearly equal words."""
    return P.connected_groups(reports(spark, d))


@register("partition_grouped", f"with {_connected(False)}, s as (select group_id, {_U8} as u from members group by group_id) select record_id, group_id, case when u < 0.7 then 'train' when u < 0.85 then 'validation' else 'test' end as split from members join s using (group_id)")
def partition_grouped(spark, d):
    return P.partition(reports(spark, d))


def _held(value: str, held: str, vendor: bool = False) -> str:
    return f"with {_connected(vendor)}, s as (select group_id, bool_or({value} = '{held}') as held, {_U8} as u from members join reports using (record_id) group by group_id) select record_id, group_id, case when held then 'test' when u < 0.8 then 'train' else 'validation' end as split from members join s using (group_id)"


@register("partition_vendor", _held("lower(vendor)", "src7", True))
def partition_vendor(spark, d):
    """A vendor's reports and all that is connected to them are the test."""
    return P.partition(reports(spark, d), "vendor", ["SRC7"])


@register("partition_industry", _held("domain", "aviation"))
def partition_industry(spark, d):
    return P.partition(reports(spark, d), "industry", ["aviation"])


_TEMPLATE_OF = "(select template from reports where record_id = '17')"


@register("partition_template", _held("template", "X").replace("template = 'X'", f"template = {_TEMPLATE_OF}"))
def partition_template(spark, d):
    rows = reports(spark, d)
    held = rows.where("record_id = '17'").select(T.vendor_template_key(F.col("narrative"), F.col("vendor")).alias("k")).first()
    return P.partition(rows, "template", [held["k"] if held else ""])


@register("partition_temporal", f"with {_connected(False)}, p as (select group_id, case when report_date is null then 'quarantine' when report_date <= '2006-06-30' then 'train' when report_date <= '2008-06-30' then 'validation' else 'test' end as s from members join reports using (record_id)), g as (select group_id, case when min(s) = max(s) then min(s) else 'quarantine' end as split from p group by group_id) select record_id, group_id, split from members join g using (group_id)")
def partition_temporal(spark, d):
    return P.partition(reports(spark, d), "temporal", train_end="2006-06-30", validation_end="2008-06-30")


@register("assignment_lookup", f"with {_connected(False)}, s as (select group_id, {_U8} as u from members group by group_id), a as (select record_id, case when u < 0.7 then 'train' when u < 0.85 then 'validation' else 'test' end as split from members join s using (group_id)) select split, domain, count(*) as n from reports join a using (record_id) group by all")
def assignment_lookup(spark, d):
    """Records joined to their assignment."""
    rows = reports(spark, d)
    return rows.join(P.partition(rows).select("record_id", "split"), "record_id").groupBy("split", "domain").agg(F.count("*").alias("n"))


def silver(spark, d):
    from gaugeline.plans import fixtures as fx

    rows = fx.reports(spark, d).select("record_id", "domain", F.element_at(F.array(*[F.lit(x) for x in C.SPLITS]), F.col("template") % 3 + 1).alias("split"), F.col("report_id").alias("group_id"), F.col("narrative").alias("clean_text"))
    return P.silver_labels(rows, LABELS)


_SILVER = "sv as materialized (select record_id, domain, ['train', 'validation', 'test'][1 + template % 3] as split, narrative from reports), own as materialized (select s.* from spans s where label <> 'COMPONENT')"


def _silver_sql(body: str) -> str:
    from gaugeline.plans import fixtures as fx

    return f"with {fx.SPANS_SQL}, {_SILVER} {body}"


@register("silver_labels", _silver_sql("select r.record_id, count(s.record_id)::int as entities, 0 as errors, array_to_string(list_filter([case when count(s.record_id) = 0 then 'no_entities' end, case when count(*) filter (s.assertion <> 'present') > 0 then 'non_present_assertion' end, case when count(*) filter (s.confidence < 0.9) > 0 then 'dictionary_match' end], lambda x: x is not null), ',') as reasons from sv r left join own s using (record_id) group by r.record_id"))
def silver_labels(spark, d):
    return silver(spark, d).select("record_id", F.size("entities").alias("entities"), F.size("errors").alias("errors"), F.array_join("review_reasons", ",").alias("reasons"))


@register("silver_report", _silver_sql("select split, domain, null as label, count(*) as n from sv group by split, domain union all select split, domain, label, count(*) from sv join own using (record_id) group by all"))
def silver_report(spark, d):
    return P.silver_report(silver(spark, d))
