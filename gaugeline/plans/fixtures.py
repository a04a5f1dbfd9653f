"""Inspection reports made from the relational tables, in Spark and in SQL.

One report row for each lineitem, with its narrative from one of eight templates.
The SQL constants are chains of common table expressions that the oracles extend.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators.analytics import with_shown
from gaugeline.operators.extract import CATEGORIES, DOMAINS, GENERIC, LINKED, extract, findings, once_a_text
from gaugeline.session import spread, table

PARTS = {"COMPONENT": ["anvil", "widget", "ring", "bolt", "gear", "gizmo", "plate", "rod", "housing"]}
MATERIALS, DEFECTS = ("Steel", "Copper", "Ceramic", "Brass"), ("cracked", "leaking", "corroded", "worn", "damaged")

_CHOOSE = "element_at(array({}), cast({} as int) + 1)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to part, supplier and orders; only the columns that the narratives need are read."""
    line = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    rows = line.join(part, "l_partkey").join(supplier, "l_suppkey").join(orders, "l_orderkey")
    names = lambda xs: ", ".join(f"'{x}'" for x in xs)
    rows = rows.withColumns(
        {
            "t": F.expr("(l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 8"),
            "mat": F.expr(_CHOOSE.format(names(MATERIALS), "l_partkey % 4")),
            "df": F.expr(_CHOOSE.format(names(DEFECTS), "(l_orderkey + l_linenumber) % 5")),
            "comp": F.expr("split(p_name, ' ')[1]"),
            "q": F.expr("cast(l_quantity as int)"),
        }
    )
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q").alias("record_id"),
        F.expr("""case t when 0 then concat(mat, ' ', comp, ' ', df, ' at ', q, ' mm.') when 1 then concat('No crack observed on the ', comp, '.')
            when 2 then concat('Critical ', lower(mat), ' ', comp, ' ', df, '. Replace immediately.') when 3 then 'Previous leak documented. The crack was repaired.'
            when 4 then concat(mat, ' ', comp, ' exhibits flensing.') when 5 then concat(mat, ' ', comp, ' ', df, '; copper housing leaking.')
            when 6 then 'No defects were found.' else concat('Possible leak near the ', comp, ', contact user', l_suppkey, '@example.com.') end""").alias("narrative"),
        F.expr("case substring(o_orderpriority, 1, 1) when '1' then 'construction' when '2' then 'aviation' when '3' then 'pipeline' else 'general' end").alias("domain"),
        F.col("s_name").alias("vendor"),
        F.col("l_orderkey").cast("string").alias("report_id"),
        F.expr("case when t = 6 then null else date_format(l_shipdate, 'yyyy-MM-dd') end").alias("report_date"),
        F.col("p_brand").alias("batch"),
        F.col("l_partkey").cast("string").alias("asset_id"),
        F.expr("case when l_linenumber % 3 = 0 then 'reviewed' when l_linenumber % 3 = 1 then 'in_progress' end").alias("report_status"),
        F.expr("cast(t as int)").alias("template"),
    )


def spanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with entities and clauses; their narratives repeat."""
    return once_a_text(reports(spark, sf_dir), lambda rows: extract(rows, packs=[PARTS]))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with findings and what rows of these show."""
    return once_a_text(reports(spark, sf_dir), lambda rows: with_shown(findings(extract(rows, packs=[PARTS]))))


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


_LEXICON = [(label, t, "all") for pack in (GENERIC, PARTS) for label, terms in pack.items() for t in terms] + [(label, t, d) for d, pack in DOMAINS.items() for label, terms in pack.items() for t in terms]

REPORTS_SQL = f"""
reports as materialized (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, q) as record_id,
    case t when 0 then mat || ' ' || comp || ' ' || df || ' at ' || q || ' mm.' when 1 then 'No crack observed on the ' || comp || '.'
      when 2 then 'Critical ' || lower(mat) || ' ' || comp || ' ' || df || '. Replace immediately.' when 3 then 'Previous leak documented. The crack was repaired.'
      when 4 then mat || ' ' || comp || ' exhibits flensing.' when 5 then mat || ' ' || comp || ' ' || df || '; copper housing leaking.'
      when 6 then 'No defects were found.' else 'Possible leak near the ' || comp || ', contact user' || l_suppkey || '@example.com.' end as narrative,
    case o_orderpriority[1] when '1' then 'construction' when '2' then 'aviation' when '3' then 'pipeline' else 'general' end as domain,
    s_name as vendor, l_orderkey::varchar as report_id, case when t = 6 then null else strftime(l_shipdate, '%Y-%m-%d') end as report_date,
    p_brand as batch, l_partkey::varchar as asset_id, case l_linenumber % 3 when 0 then 'reviewed' when 1 then 'in_progress' end as report_status, t::int as template
  from (select *, (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 8 as t, {list(MATERIALS)}[1 + l_partkey % 4] as mat, {list(DEFECTS)}[1 + (l_orderkey + l_linenumber) % 5] as df,
    split_part(p_name, ' ', 2) as comp, l_quantity::int as q
    from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey))
"""

#: Spans on distinct narratives: word starts joined to terms; a term of more words beats one it overlaps.
SPANS_SQL = (
    REPORTS_SQL
    + f""",
texts as materialized (select distinct narrative, domain from reports),
lexicon(label, term, scope) as (values {_values(_LEXICON)}),
terms as (select term, scope, any_value(label) as label, len(string_split(term, ' ')) as words from lexicon group by term, scope),
letters as (select narrative, domain, unnest(range(1, length(narrative) + 1)) as i from texts),
begins as (select *, substr(narrative, i, 1) as c, case when i > 1 then substr(narrative, i - 1, 1) else ' ' end as b from letters),
at_word as (select narrative, domain, i from begins where regexp_matches(c, '[A-Za-z0-9_]') and not regexp_matches(b, '[A-Za-z0-9_]')),
hits as materialized (select distinct narrative, domain, label, i - 1 as start, i - 1 + length(term) as stop, words, 2 as tier
  from (select *, lower(regexp_extract(substr(narrative, i), '^[A-Za-z0-9_]+')) as head from at_word) w join (select *, split_part(term, ' ', 1) as first from terms) t on w.head = t.first
  where scope in ('all', domain) and lower(substr(narrative, i, length(term))) = term and not regexp_matches(substr(narrative, i + length(term), 1), '[A-Za-z0-9_]')),
measures as materialized (select narrative, domain, 'MEASUREMENT' as label, i - 1 as start, i - 1 + length(regexp_extract(substr(narrative, i), '^[0-9]+ mm\\b')) as stop, 1 as words, 1 as tier
  from at_word where regexp_matches(substr(narrative, i), '^[0-9]+ mm\\b')),
all_hits as materialized (select * from hits union all select * from measures),
kept as materialized (select * from all_hits a where not exists (select 1 from all_hits o where o.narrative = a.narrative and o.domain = a.domain and o.start < a.stop and o.stop > a.start
  and (o.tier < a.tier or (o.tier = a.tier and (o.words > a.words or (o.words = a.words and o.start < a.start)))))),
around as (select *, substr(narrative, start + 1, stop - start) as text,
  lower(list_last(string_split_regex(substr(narrative, 1, start), '(?i)[.!?;]|\\b(?:but|however|although)\\b'))) as bb,
  string_split_regex(lower(string_split_regex(substr(narrative, stop + 1), '(?i)[.!?;]|\\b(?:but|however|although)\\b')[1]), '\\b(?:and|or)\\b')[1] as aa from kept),
near as (select *, array_to_string(list_filter(string_split_regex(bb, '\\s+'), lambda x: x <> '')[-6:], ' ') as bw, array_to_string(list_filter(string_split_regex(aa, '\\s+'), lambda x: x <> '')[1:6], ' ') as aw from around),
text_spans as materialized (select narrative, domain, label, text, start, stop,
  case when regexp_matches(bw, '\\b(?:failed to (?:find|detect|observe)|no|without|neither|denies)\\b') or regexp_matches(aw, '^\\s*(?:was |is |were )?(?:not (?:found|observed|detected)|absent)\\b') then 'negated'
    when regexp_matches(bw, '\\b(?:possible|possibly|suspected|may|might|potential)\\b') or regexp_matches(aw, '^\\s*(?:was |is )?(?:suspected|possible)\\b') then 'possible'
    when regexp_matches(bw, '\\b(?:previous|previously|historical|history of)\\b') then 'historical'
    when regexp_matches(bw, '\\b(?:repaired|resolved|rectified|corrected)\\s*$') or regexp_matches(aw, '^\\s*(?:(?:has|have) been |was |were |is )?(?:repaired|resolved|rectified|corrected)\\b') then 'resolved'
    else 'present' end as assertion, case tier when 1 then 0.95 else 0.75 end::double as confidence, case tier when 1 then 'regex' else 'ruler' end as method from near),
spans as materialized (select record_id, s.* exclude (narrative, domain) from reports r join text_spans s using (narrative, domain))
"""
)

#: Clauses end at punctuation that follows no digit; the templates have no other boundary.
CLAUSES_SQL = """,
cuts as (select narrative, list_filter(range(1, length(narrative) + 1), lambda i: substr(narrative, i, 1) in ('.', '!', '?', ';') and (i = 1 or not regexp_matches(substr(narrative, i - 1, 1), '[0-9]'))) as marks
  from (select distinct narrative from texts)),
pieces as (select narrative, unnest(list_zip(list_prepend(0, marks), list_append(list_transform(marks, lambda i: i - 1), length(narrative)))) as p from cuts),
text_clauses as materialized (select narrative, p[1] as start, p[2] as stop from pieces where trim(substr(narrative, p[1] + 1, p[2] - p[1])) <> ''),
clauses as materialized (select record_id, start, stop from reports join text_clauses using (narrative))
"""

FINDINGS_SQL = (
    SPANS_SQL
    + CLAUSES_SQL
    + f""",
categories(category, term) as (values {_values([(c, t) for c, ts in CATEGORIES.items() for t in ts])}),
defects as materialized (select s.*, coalesce(c.start, s.start) as clause_start, coalesce(c.stop, s.stop) as clause_stop from spans s
  left join clauses c on c.record_id = s.record_id and c.start <= s.start and s.start < c.stop where label = 'DEFECT'),
local as materialized (select d.record_id, d.start as defect_start, e.label, e.text, e.start, e.stop,
  count(*) filter (e.label = 'DEFECT') over (partition by d.record_id, d.start) as n_defects, count(*) over (partition by d.record_id, d.start, e.label) as n_label
  from defects d join spans e on e.record_id = d.record_id and d.clause_start <= e.start and e.stop <= d.clause_stop),
links as materialized (select record_id, defect_start, label, text, start, stop from local where label in ({", ".join(f"'{x}'" for x in LINKED)}) and n_defects = 1 and n_label = 1),
flags as materialized (select record_id, defect_start, bool_or(n_defects > 1 or (label in ({", ".join(f"'{x}'" for x in LINKED)}) and n_label > 1)) as ambiguous from local group by all),
linked as materialized (select record_id, defect_start, list(lower(text) order by start) filter (label = 'COMPONENT') as component, list(lower(text) order by start) filter (label = 'MATERIAL') as material,
  list(lower(text) order by start) filter (label = 'REPORTED_SEVERITY') as severity, list(lower(text) order by start) filter (label = 'CORRECTIVE_ACTION') as action from links group by all),
base as materialized (select d.record_id || ':defect:' || d.start as finding_id, r.record_id, r.report_id, r.vendor, r.domain, r.report_date as date, r.batch, r.asset_id, coalesce(report_status, 'pending') as workflow,
  d.text as evidence, d.start, d.stop, d.assertion, c.category, coalesce(c.category, 'Uncategorized: ' || lower(d.text)) as defect, f.ambiguous,
  coalesce(l.component, ['Unknown']) as component, coalesce(l.material, ['Unknown']) as material, coalesce(l.severity, ['Unknown']) as severity, coalesce(l.action, []) as action
  from defects d join reports r using (record_id) join flags f on f.record_id = d.record_id and f.defect_start = d.start
  left join linked l on l.record_id = d.record_id and l.defect_start = d.start left join categories c on c.term = lower(d.text)),
tiered as (select *, assertion in ('negated', 'historical', 'resolved') as low, list_has_any(severity, ['major', 'critical', 'severe']) as severe, len(list_filter(action, lambda a: regexp_matches(a, 'urgent|immediate'))) > 0 as urgent from base),
findings as materialized (select *, case when low then 'low' when severe or urgent then 'high' else 'normal' end as priority,
  concat_ws('; ', 'Defect assertion is ' || assertion, case when not low and severe then 'Explicit linked major/critical/severe wording' end,
    case when not low and urgent then 'Explicit linked urgent corrective action' end, case when ambiguous then 'Ambiguous evidence associations require review' end) as reasons from tiered)
"""
)

CANDIDATES_SQL = """,
candidates as materialized (select r.record_id, c.start + length(p) - length(ltrim(p)) as start, c.stop - (length(p) - length(rtrim(p))) as stop, trim(p) as text
  from (select *, substr(narrative, start + 1, stop - start) as p from reports join text_clauses using (narrative)) c join reports r using (record_id)
  where regexp_matches(p, '(?i)\\b(?:inspect\\w*|observ\\w*|detect\\w*|exhibits|shows|found|repair\\w*|replace\\w*|reject\\w*|abnormal\\w*|nonconform\\w*)\\b')
    and not regexp_matches(p, '(?i)\\bno\\s+(?:material\\s+)?(?:defects?|deficiencies|damage)\\s+(?:(?:was|were)\\s+)?(?:found|observed|detected)\\b')
    and not exists (select 1 from spans s where s.record_id = c.record_id and s.label = 'DEFECT' and c.start <= s.start and s.start < c.stop))
"""
