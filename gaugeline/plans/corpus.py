"""Queries of text keys, groups, splits and samples over documents and labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators import corpus as C
from gaugeline.plans.catalogue import register
from gaugeline.session import spread, table

SEED = "gaugeline-v1"
# ASCII white space and words, so that both engines' classes agree; texts hold no other white space
NORM = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
EXACT = f"case when {NORM} = '' then '' else sha256(lower({NORM})) end"
_TEMPLATE = rf"list_transform(regexp_extract_all(lower({NORM}), '[\p{{L}}\p{{N}}_\p{{M}}]+(?:[.-][\p{{L}}\p{{N}}_\p{{M}}]+)*'), lambda t: case when regexp_full_match(t, '\d+(?:\.\d+)?') then '<NUMBER>' else t end)"
_W = r"\p{L}\p{N}_\p{M}"
#: The detectors without look-around, which DuckDB lacks: what may not stand before or after is matched and put back.
DETECT = {
    "email": rf"(?i)(^|[^{_W}])([{_W}.+-]+@[{_W}.-]+\.[A-Za-z]{{2,}})\b",
    "phone": rf"(^|[^{_W}])((?:\+?1[ .-]?)?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}})\b",
    "coordinates": rf"(^|[^{_W}.])(-?\d{{1,3}}\.\d{{4,}}\s*[,;/]\s*-?\d{{1,3}}\.\d{{4,}})",
    "named_coordinate": rf"(?i)(^|[^{_W}])((?:latitude|longitude|lat|lon|long)\s*[:=]?\s*-?\d{{1,3}}\.\d+)",
    "street": rf"(?i)(^|[^{_W}])(\d{{1,6}}\s+(?:[{_W}.-]+\s+){{1,5}}(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|court|ct|way)\b\.?)",
    "registration": rf"(^|[^{_W}])((?:N\d{{1,5}}[A-Z]{{0,2}}|[A-Z]{{1,3}}-\d{{2,6}}))(?:$|[^{_W}])",
    "personal_name": rf"(?i)(^|[^{_W}])((?:mr\.?|mrs\.?|ms\.?|dr\.?|inspector|reported by|contact)\s+[A-Z][a-z]+\s+[A-Z][a-z]+)(?:$|[^{_W}])",
}
CLEAN = NORM
for _name in ("email", "phone", "coordinates", "named_coordinate", "street"):
    CLEAN = rf"regexp_replace({CLEAN}, '{DETECT[_name]}', '\1[REDACTED]', 'g')"
_HITS = ", ".join(f"case when regexp_matches(t, '{p}') then '{n}' end" for n, p in DETECT.items())
RISKS = f"list_sort(list_filter([{_HITS}, case when r <> t then 'redaction_change' end], lambda x: x is not null))"
RISKY = f"risky as (select doc_id, source, array_to_string({RISKS}, ',') as risks from (select doc_id, source, {NORM} as t, {CLEAN} as r from documents))"
KEYS = f"keyed as (select doc_id::varchar as record_id, source, lang, n_chars, {EXACT} as exact, sha256('sample-v1:' || doc_id) as sample_rank from documents)"
UNIT = "('0x' || substr(sha256({}), 1, 8))::bigint / 4294967296.0::double"


def docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def keyed(spark, d):
    return docs(spark, d).select(F.col("doc_id").cast("string").alias("record_id"), "source", "lang", "n_chars", T.exact_key(F.col("text")).alias("exact"), C.sample_rank(F.col("doc_id").cast("string")).alias("sample_rank"))


def labelled(spark, d):
    return keyed(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("record_id"), F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("label")), "record_id", "left").withColumn("label", F.coalesce("label", F.lit("")))


LABELLED = KEYS + ", labelled as (select k.*, coalesce('q' || quality || 't' || toxic, '') as label from keyed k left join labels l on l.doc_id::varchar = k.record_id)"


@register("normalise_whitespace", f"select doc_id, {NORM} as clean from documents")
def normalise_whitespace(spark, d):
    return docs(spark, d).select("doc_id", T.collapse(F.coalesce("text", F.lit(""))).alias("clean"))


def risky(spark, d):
    return docs(spark, d).select("doc_id", "source", F.array_join(T.risks(T.collapse(F.coalesce("text", F.lit("")))), ",").alias("risks"))


@register("redaction_flags", f"with {RISKY} select doc_id, risks from risky")
def redaction_flags(spark, d):
    """Names of all detectors that find something in a document, and whether redaction changes it."""
    return risky(spark, d).select("doc_id", "risks")


@register("redacted_texts", f"select doc_id, {CLEAN} as clean, {CLEAN} <> {NORM} as sensitive from documents")
def redacted_texts(spark, d):
    found = docs(spark, d).select("doc_id", T.prepare(F.coalesce("text", F.lit(""))).alias("c"))
    return found.select("doc_id", F.col("c.text").alias("clean"), F.col("c.sensitive").alias("sensitive"))


@register("pii_by_source", f"with {RISKY} select source, count(*) as records, count(*) filter (risks <> '') as flagged, count(*) filter (contains(risks, 'redaction_change')) as redacted from risky group by source")
def pii_by_source(spark, d):
    return risky(spark, d).groupBy("source").agg(F.count("*").alias("records"), F.count_if(F.col("risks") != "").alias("flagged"), F.count_if(F.contains("risks", F.lit("redaction_change"))).alias("redacted"))


@register("token_stats", f"with w as (select source, len(list_filter(string_split({NORM}, ' '), lambda x: x <> ''))::int as words from documents), r as (select *, row_number() over (partition by source order by words) as i, count(*) over (partition by source) as n from w) select source, count(*) as count, round_even(avg(words), 4) as mean, max(words) filter (i = n // 2 + 1) as median, min(words) as least, max(words) as most from r group by source")
def token_stats(spark, d):
    return C.upper_median(docs(spark, d).select("source", T.token_count(F.col("text")).alias("words")), "words", "source")


@register("exact_template_keys", f"select doc_id, {EXACT} as exact, case when len(w) >= 8 then sha256(array_to_string(w, ' ')) end as template from (select *, {_TEMPLATE} as w from documents)")
def exact_template_keys(spark, d):
    return docs(spark, d).select("doc_id", T.exact_key(F.col("text")).alias("exact"), T.template_key(F.col("text")).alias("template"))


@register("duplicate_counts", f"with {KEYS} select count(*) - count(distinct exact) as extra_exact from keyed where exact <> ''")
def duplicate_counts(spark, d):
    return keyed(spark, d).where("exact <> ''").agg((F.count("*") - F.count_distinct("exact")).alias("extra_exact"))


@register("hash_scores", f"select doc_id, {UNIT.format(f"'{SEED}:' || doc_id")} as score from documents")
def hash_scores(spark, d):
    return table(spark, d, "documents").select("doc_id", T.unit_hash(F.concat(F.lit(f"{SEED}:"), F.col("doc_id").cast("string"))).alias("score"))


@register("hash_split_70_15_15", f"select doc_id, case when s < 0.7 then 'train' when s < 0.85 then 'validation' else 'test' end as split from (select doc_id, {UNIT.format(f"'{SEED}:' || doc_id")} as s from documents)")
def hash_split_70_15_15(spark, d):
    return table(spark, d, "documents").select("doc_id", C.grouped_split(F.col("doc_id").cast("string"), SEED).alias("split"))


GROUPS = KEYS + ", firsts as (select exact, min(record_id) as first from keyed where exact <> '' group by exact), members as (select record_id, coalesce(first, record_id) as group_id, k.* exclude (record_id) from keyed k left join firsts using (exact))"


@register("hash_split_80_10_10", f"with {GROUPS} select record_id, case when held then 'test' when s < 0.8 then 'train' else 'validation' end as split from members join (select group_id, bool_or(source = 'src7') as held, {UNIT.format(f"'{SEED}:' || group_id")} as s from members group by group_id) using (group_id)")
def hash_split_80_10_10(spark, d):
    """A held-out source goes to test with all that is connected to it; the others never do."""
    rows = keyed(spark, d)
    members = C.groups(rows, ["exact"])
    held = members.join(rows.select("record_id", "source"), "record_id").groupBy("group_id").agg(F.max(F.col("source") == "src7").alias("held"))
    score = T.unit_hash(F.concat(F.lit(f"{SEED}:"), "group_id"))
    return members.join(held, "group_id").select("record_id", F.when(F.col("held"), "test").when(score < 0.8, "train").otherwise("validation").alias("split"))


COMPONENTS = f"""
recursive {KEYS},
firstwords as (select doc_id::varchar as record_id, array_to_string(list_filter(string_split({NORM}, ' '), lambda x: x <> '')[1:4], ' ') as opening from documents),
e as (select a.record_id as a, b.record_id as b from keyed a join keyed b using (exact) where exact <> '' union select a.record_id, b.record_id from firstwords a join firstwords b using (opening) where opening <> ''),
walk as (select record_id as a, record_id as b from keyed union select w.a, e.b from walk w join e on w.b = e.a)
"""


@register("components_exact_opening", f"with {COMPONENTS} select a as record_id, min(b) as group_id from walk group by a")
def components_exact_opening(spark, d):
    """Connected over equal texts and equal first four words."""
    opening = F.array_join(F.slice(T.tokens(F.col("text")), 1, 4), " ")
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("record_id"), T.exact_key(F.col("text")).alias("exact"), opening.alias("opening"))
    return C.groups(rows, ["exact", "opening"])


@register("group_sizes", f"with {GROUPS} select size, count(*) as groups from (select count(*) as size from members group by group_id) group by size")
def group_sizes(spark, d):
    return C.groups(keyed(spark, d), ["exact"]).groupBy("group_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


@register("group_table", f"with {GROUPS} select group_id, count(*) as members, string_agg(distinct source, ',' order by source) as sources from members group by group_id")
def group_table(spark, d):
    rows = keyed(spark, d).select("record_id", "source")
    return C.groups(keyed(spark, d), ["exact"]).join(rows, "record_id").groupBy("group_id").agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


YEAR = "(2008 + doc_id % 19)"


@register("temporal_periods", f"select doc_id, case when y = 2026 then 'demo' when y = 2025 then 'test' when y = 2024 then 'validation' when y between 2010 and 2023 then 'train' else 'quarantine' end as period from (select doc_id, {YEAR} as y from documents)")
def temporal_periods(spark, d):
    return docs(spark, d).select("doc_id", C.period(F.expr(YEAR)).alias("period"))


@register("group_consistency_quarantine", f"with {GROUPS} select group_id, case when min(p) = max(p) then min(p) else 'quarantine' end as temporal from (select group_id, case when y = 2026 then 'demo' when y = 2025 then 'test' when y = 2024 then 'validation' when y between 2010 and 2023 then 'train' else 'quarantine' end as p from (select *, 2008 + record_id::bigint % 19 as y from members)) group by group_id")
def group_consistency_quarantine(spark, d):
    members = C.groups(keyed(spark, d), ["exact"]).withColumn("year", F.expr("2008 + cast(record_id as bigint) % 19"))
    return C.consistent(members, "group_id", C.period(F.col("year")), "temporal")


@register("split_policy_updates", f"with {GROUPS} select record_id, case when n_chars < 100 then 'excluded' when 2008 + record_id::bigint % 19 = 2026 then 'demo' when s < 0.7 then 'train' when s < 0.85 then 'validation' else 'test' end as grouped from (select *, {UNIT.format(f"'{SEED}:' || group_id")} as s from members)")
def split_policy_updates(spark, d):
    """Later rules of the policy win, so they are tested first."""
    rows = keyed(spark, d).select("record_id", "n_chars")
    members = C.groups(keyed(spark, d), ["exact"]).join(rows, "record_id")
    year = F.expr("2008 + cast(record_id as bigint) % 19")
    return members.select("record_id", F.when(F.col("n_chars") < 100, "excluded").when(year == 2026, "demo").otherwise(C.grouped_split(F.col("group_id"), SEED)).alias("grouped"))


@register("leakage_check", f"with {GROUPS}, s as (select group_id, case when record_id::bigint % 50 = 0 then 'test' else 'train' end as split from members), g as (select group_id from s group by group_id having count(distinct split) > 1) select count(*) as leaking_groups from g")
def leakage_check(spark, d):
    """Split by record instead of group, so that groups leak; a split by group leaks none, which the tests check."""
    members = C.groups(keyed(spark, d), ["exact"])
    return C.leaks(members.withColumn("split", F.when(F.expr("cast(record_id as bigint) % 50 = 0"), "test").otherwise("train")))


@register("label_conflicts_anti", f"with {LABELLED}, c as (select source from labelled where label <> '' group by source having count(distinct label) > 3) select record_id, label from labelled where label <> '' and source not in (select source from c)")
def label_conflicts_anti(spark, d):
    rows = labelled(spark, d)
    many = rows.where("label <> ''").groupBy("source").agg(F.count_distinct("label").alias("n")).where("n > 3")
    return rows.where("label <> ''").join(many, "source", "left_anti").select("record_id", "label")


@register("label_conflicts", f"with {LABELLED} select exact from labelled where label <> '' group by exact having count(distinct label) > 1")
def label_conflicts(spark, d):
    return C.conflicts(labelled(spark, d), ["exact"])


@register("representatives_row_number", f"with {LABELLED} select record_id, source, label from (select *, row_number() over (partition by source, label order by sample_rank, record_id) as i from labelled where label <> '') where i = 1")
def representatives_row_number(spark, d):
    return C.representatives(labelled(spark, d).where("label <> ''"), ["source", "label"]).select("record_id", "source", "label")


@register("source_split_loader", f"with {LABELLED}, s as (select *, {UNIT.format(f"'{SEED}:' || exact")} as u from labelled), c as (select exact from labelled where label <> '' group by exact having count(distinct label) > 1), r as (select exact, min(record_id) as record_id, min(label) as label, case when min(u) < 0.7 then 'train' when min(u) < 0.85 then 'validation' else 'test' end as split from s where label <> '' and exact not in (select exact from c) group by exact) select record_id, label, split from r where split <> 'train'")
def source_split_loader(spark, d):
    rows = labelled(spark, d).where("label <> ''")
    clean = rows.join(C.conflicts(rows, ["exact"]), "exact", "left_anti")
    one = clean.groupBy("exact").agg(F.min("record_id").alias("record_id"), F.min("label").alias("label"))
    return one.select("record_id", "label", C.grouped_split(F.col("exact"), SEED).alias("split")).where("split <> 'train'")


STRATA = f"with {LABELLED}, strata as (select label, lang, count(*) as n from labelled where label <> '' group by all)"


@register("sample_largest_remainder", f"{STRATA}, t as (select *, sum(n) over () as total from strata), q as (select *, (least(150, total) * n // total)::bigint as base, least(150, total) * n % total as rest from t), k as (select *, row_number() over (order by rest desc, label, lang) as place, least(150, total) - sum(base) over () as leftover from q) select label, lang, n, (base + case when place <= leftover then 1 else 0 end)::bigint as quota from k")
def sample_largest_remainder(spark, d):
    strata = labelled(spark, d).where("label <> ''").groupBy("label", "lang").agg(F.count("*").alias("n"))
    return C.largest_remainder(strata, 150, ["label", "lang"])


@register("sample_stratified_topk", f"{STRATA}, t as (select *, sum(n) over () as total from strata), q as (select *, least(150, total) * n // total as base, least(150, total) * n % total as rest from t), k as (select *, base + case when row_number() over (order by rest desc, label, lang) <= least(150, total) - sum(base) over () then 1 else 0 end as quota from q), r as (select *, row_number() over (partition by label, lang order by sample_rank, record_id) as i from labelled where label <> '') select record_id, r.label, r.lang from r join k using (label, lang) where i <= quota")
def sample_stratified_topk(spark, d):
    rows = labelled(spark, d).where("label <> ''")
    quotas = C.largest_remainder(rows.groupBy("label", "lang").agg(F.count("*").alias("n")), 150, ["label", "lang"])
    return C.take_quota(rows, quotas, ["label", "lang"]).select("record_id", "label", "lang")


@register("training_sample", f"with {LABELLED}, s as (select *, {UNIT.format(f"'{SEED}:' || record_id")} as u from labelled where label <> '' and exact <> ''), k as (select exact from s group by exact having count(distinct label) > 1), one as (select * from (select *, row_number() over (partition by exact order by sample_rank, record_id) as i from s where exact not in (select exact from k) and u < 0.7) where i = 1), n as (select label, lang, count(*) as n from one group by all), t as (select *, sum(n) over () as total from n), q as (select *, least(90, total) * n // total as base, least(90, total) * n % total as rest from t), g as (select *, base + case when row_number() over (order by rest desc, label, lang) <= least(90, total) - sum(base) over () then 1 else 0 end as quota from q), r as (select *, row_number() over (partition by label, lang order by sample_rank, record_id) as j from one) select record_id, r.label, r.lang from r join g using (label, lang) where j <= quota")
def training_sample(spark, d):
    """One record of each group without a conflict of labels, of the training split, by proportional quotas."""
    rows = labelled(spark, d).where("label <> '' and exact <> ''").withColumn("split", C.grouped_split(F.col("record_id"), SEED))
    return C.training_sample(rows, "exact", ["label", "lang"], 90).select("record_id", "label", "lang")


@register("allocate_near_equal", f"with {LABELLED}, s as (select distinct source, label from labelled where label <> ''), q as (select *, 10 // count(*) over (partition by source) + case when row_number() over (partition by source order by label) <= 10 % count(*) over (partition by source) then 1 else 0 end as quota from s), r as (select *, row_number() over (partition by source, label order by sample_rank, record_id) as i from labelled where label <> '') select record_id, r.source, r.label from r join q using (source, label) where i <= quota")
def allocate_near_equal(spark, d):
    rows = labelled(spark, d).where("label <> ''")
    quotas = C.near_equal(rows.select("source", "label").distinct(), 10, "source", "label")
    return C.take_quota(rows, quotas, ["source", "label"]).select("record_id", "source", "label")


@register("silver_ranked_candidates", f"with {LABELLED}, b as (select *, {UNIT.format(f"'{SEED}:' || record_id")} as u from labelled where label <> ''), base as (select *, case when u < 0.7 then 'train' when u < 0.85 then 'validation' else 'test' end as split from b), safe as (select exact from base group by exact having count(distinct split) = 1), one as (select * from (select *, row_number() over (partition by source, exact order by sample_rank) as g from base where exact in (select exact from safe)) where g = 1), l as (select source, split, label, row_number() over (partition by source, split order by count(*) desc, label) as label_rank from one group by source, split, label), r as (select *, row_number() over (partition by source, split, label order by sample_rank) as in_label from one) select r.record_id, r.source, r.label, r.split from r join l on (r.source, r.split, r.label) = (l.source, l.split, l.label) where label_rank <= 2 and in_label <= 5")
def silver_ranked_candidates(spark, d):
    base = labelled(spark, d).where("label <> ''").withColumn("split", C.grouped_split(F.col("record_id"), SEED))
    safe = base.groupBy("exact").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo = hi").select("exact")
    one = C.representatives(base.join(safe, "exact", "left_semi"), ["source", "exact"])
    counted = one.groupBy("source", "split", "label").agg(F.count("*").alias("n"))
    top = counted.withColumn("label_rank", F.row_number().over(Window.partitionBy("source", "split").orderBy(F.desc("n"), "label"))).where("label_rank <= 2")
    ranked = one.withColumn("in_label", F.row_number().over(Window.partitionBy("source", "split", "label").orderBy("sample_rank"))).where("in_label <= 5")
    return ranked.join(top.select("source", "split", "label"), ["source", "split", "label"]).select("record_id", "source", "label", "split")


@register("hash_ordered_limit", "select doc_id from documents order by sha256('annotation-v1:' || doc_id), doc_id limit 25")
def hash_ordered_limit(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(C.sample_rank(F.col("doc_id").cast("string"), "annotation-v1"), "doc_id").limit(25)


_JACCARD = "words as (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) as w from documents), sets as (select doc_id::varchar as id, w from words where len(w) >= 8), t as (select id, len(w) as n, unnest(w) as x from sets), c as (select a.id as a, b.id as b, a.n as na, b.n as nb, count(*) as common from t a join t b on a.x = b.x and a.id < b.id and least(a.n, b.n) >= 0.9 * greatest(a.n, b.n) group by all)"


@register("jaccard_near_duplicates", f"with {_JACCARD} select a, b, common / (na + nb - common)::double as jaccard from c where common / (na + nb - common)::double >= 0.9")
def jaccard_near_duplicates(spark, d):
    return C.jaccard_pairs(C.token_sets(docs(spark, d).withColumn("record_id", F.col("doc_id").cast("string")), "text"))


@register("column_distributions", "select 'lang' as \"column\", lang as value, count(*) as n from documents group by all union all select 'source', source, count(*) from documents group by all union all select 'lang,source', lang || ',' || source, count(*) from documents group by all")
def column_distributions(spark, d):
    """One scan: grouping sets."""
    table(spark, d, "documents").createOrReplaceTempView("gaugeline_documents")
    return spark.sql(
        "select case grouping_id(lang, source) when 1 then 'lang' when 2 then 'source' else 'lang,source' end as column, concat_ws(',', lang, source) as value, count(*) as n from gaugeline_documents group by grouping sets ((lang), (source), (lang, source))"
    )


@register("source_wide_analytics", f"with {LABELLED} select source, count(*) as records, count(distinct exact) as groups, round_even(avg(n_chars), 2) as mean_chars, count(*) filter (label <> '') as labelled from labelled group by source")
def source_wide_analytics(spark, d):
    return labelled(spark, d).groupBy("source").agg(F.count("*").alias("records"), F.count_distinct("exact").alias("groups"), F.bround(F.avg("n_chars"), 2).alias("mean_chars"), F.count_if(F.col("label") != "").alias("labelled"))


@register("source_audit", "select source, count(*) as rows, count(*) filter (trim(coalesce(text, '')) = '') as empty, count(*) - count(distinct doc_id) as repeated_ids from documents group by source")
def source_audit(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated_ids"))


@register("class_counts", f"with {LABELLED} select label, count(*) as n from labelled where label <> '' group by label")
def class_counts(spark, d):
    return labelled(spark, d).where("label <> ''").groupBy("label").agg(F.count("*").alias("n"))


@register("first_n_per_file", "select doc_id, source from (select *, row_number() over (partition by source order by doc_id) as i from documents) where i <= 3")
def first_n_per_file(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, d, "documents").select("doc_id", "source", F.row_number().over(w).alias("i")).where("i <= 3").drop("i")


@register("verify_except_all", f"with {KEYS}, frozen as (select record_id, case when record_id::bigint % 101 = 0 then 'changed' else exact end as exact from keyed where record_id::bigint % 97 <> 1 union all select record_id || '-again', exact from keyed where record_id::bigint % 89 = 2), j as (select k.record_id as a, f.record_id as b, k.exact as x, f.exact as y from keyed k full join frozen f using (record_id)) select coalesce(a, b) as record_id, case when b is null then 'missing' when a is null then 'extra' else 'changed' end as kind from j where a is null or b is null or x <> y")
def verify_except_all(spark, d):
    """A frozen copy against its source by record; rows are planted that it lacks, has besides, or has otherwise."""
    from gaugeline.operators.snapshot import differences

    left, n = keyed(spark, d).select("record_id", "exact"), F.expr("cast(record_id as bigint)")
    frozen = left.where(n % 97 != 1).withColumn("exact", F.when(n % 101 == 0, "changed").otherwise(F.col("exact")))
    again = left.where(n % 89 == 2).withColumn("record_id", F.concat("record_id", F.lit("-again")))
    return differences(left, frozen.unionByName(again), "record_id")


@register("benchmark_overlap", f"select count(*) as leaked from benchmark b where exists (select 1 from documents d where lower({NORM}) = lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))))")
def benchmark_overlap(spark, d):
    """Benchmark items whose whole text is a document: one semi-join on the key."""
    items = table(spark, d, "benchmark").select("item_id", T.exact_key(F.col("text")).alias("exact"))
    return items.join(keyed(spark, d).select("exact"), "exact", "left_semi").agg(F.count("*").alias("leaked"))


@register("disjoint_ids", f"with s as (select doc_id, {UNIT.format(f"'{SEED}:' || doc_id")} as u from documents) select count(*) as shared from s where (u < 0.7 or doc_id % 40 = 0) and u >= 0.85")
def disjoint_ids(spark, d):
    """Ids that stand in training and test; some test ids are planted in training."""
    rows = table(spark, d, "documents").select("doc_id", C.grouped_split(F.col("doc_id").cast("string"), SEED).alias("split"))
    train, test = rows.where("split = 'train' or doc_id % 40 = 0").select("doc_id"), rows.where("split = 'test'").select("doc_id")
    return train.intersect(test).agg(F.count("*").alias("shared"))


_CLEANED = f"cleaned as (select doc_id, source, {CLEAN} as clean, {NORM} as norm from documents)"


@register("corpus_index", f"with {_CLEANED} select doc_id::varchar as record_id, source, case when clean = '' then '' else sha256(lower(clean)) end as exact, len(list_filter(string_split(clean, ' '), lambda x: x <> ''))::int as words, clean <> norm as sensitive, case when clean = '' then 'empty_narrative' when not regexp_matches(replace(clean, '[REDACTED]', ''), '[a-zA-Z]') then 'no_alphabetic_narrative' else '' end as excluded, sha256('sample-v1:' || doc_id) as sample_rank from cleaned")
def corpus_index(spark, d):
    return C.index(docs(spark, d), "doc_id", "text", ["source"]).drop("template")


@register("temporal_partition", f"with {GROUPS}, p as (select m.group_id, case when record_id::bigint % 10 = 0 then 'quarantine' when record_id::bigint % 10 <= 6 then 'train' when record_id::bigint % 10 <= 8 then 'validation' else 'test' end as s from members m) select group_id, case when min(s) = max(s) then min(s) else 'quarantine' end as split from p group by group_id")
def temporal_partition(spark, d):
    date = F.when(F.expr("cast(record_id as bigint) % 10") == 0, "").otherwise(F.concat(F.lit("200"), F.expr("cast(record_id as bigint) % 10").cast("string"), F.lit("-01-01")))
    return C.temporal_partition(C.groups(keyed(spark, d), ["exact"]), "group_id", date, "2006-06-30", "2008-06-30")


@register("held_out_partition", f"with {GROUPS} select group_id, case when bool_or(lang = 'es') then 'test' when {UNIT.format(f"'{SEED}:' || min(record_id)")} < 0.8 then 'train' else 'validation' end as split from members group by group_id")
def held_out_partition(spark, d):
    rows = C.groups(keyed(spark, d), ["exact"]).join(keyed(spark, d).select("record_id", "lang"), "record_id")
    return C.held_out_partition(rows, "group_id", F.col("lang"), ["es"], SEED)
