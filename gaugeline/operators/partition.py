"""Leak-free assignment: grouping over events and keys, split policies, hold-outs, quotas with refill, split loaders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators import corpus as C
from gaugeline.operators.order import indexed, mark_quota
from gaugeline.scratch import discard, materialise

#: Modes of a partition and the domains of hold-outs.
MODES = ("grouped", "vendor", "template", "industry", "temporal")
DOMAINS = ("construction", "aviation", "pipeline")


def event_year(event: Column) -> Column:
    """The year in an event's name, null if it has none."""
    return F.nullif(F.regexp_extract(event, r"SDR-(\d{4})", 1), F.lit("")).cast("int")


def domain_choice(domain: Column, temporal: Column, official: Column, grouped: Column) -> Column:
    """The split that a domain's experiments use."""
    return F.when(domain == "construction", official).when(domain == "aviation", temporal).when(domain == "pipeline", grouped)


def policies(rows: DataFrame, seed: str, keys: Sequence[str] = ("event", "exact", "template")) -> DataFrame:
    """rows(record_id, domain, year, official, excluded and the keys) with group_id, grouped, temporal, official_safe.

    Groups are connected over shared keys. A group's split is by the hash of its name; its
    period and its official split hold only if all of its members agree, else the group is in
    quarantine. Excluded rows and those of a policy's other domains stand apart; the
    policy is a chain of cases, so that a later rule of it is tested first.
    """
    members = C.groups(rows, list(keys)).join(rows.drop(*keys), "record_id")
    seen = members.groupBy("group_id").agg(
        F.min(F.when(F.col("domain") == "aviation", C.period(F.col("year")))).alias("first_period"), F.max(F.when(F.col("domain") == "aviation", C.period(F.col("year")))).alias("last_period"),
        F.min(F.when(F.col("domain") == "construction", F.col("official"))).alias("first_official"), F.max(F.when(F.col("domain") == "construction", F.col("official"))).alias("last_official"),
    )
    one = lambda a, b: F.when(F.col(a) == F.col(b), F.col(a)).otherwise("quarantine")
    out = members.join(seen, "group_id")
    gone = F.col("excluded") != ""
    return out.select(
        *members.columns,
        F.when(gone, "excluded").when(F.col("year") == 2026, "demo").otherwise(C.grouped_split(F.col("group_id"), seed)).alias("grouped"),
        F.when(gone, "excluded").when(F.col("domain") != "aviation", "not_applicable").otherwise(one("first_period", "last_period")).alias("temporal"),
        F.when(gone, "excluded").when(F.col("domain") != "construction", "not_applicable").otherwise(one("first_official", "last_official")).alias("official_safe"),
    )


def hold_outs(rows: DataFrame, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """rows(group_id, domain, grouped) with holdout_<domain>: all that is connected to the domain is its test."""
    known = rows.groupBy("group_id").agg(F.collect_set("domain").alias("domains"))  # as many as there are domains, at most

    def split(domain: str) -> Column:
        kept = F.when(F.col("grouped").isin("demo", "excluded"), F.col("grouped"))
        return kept.when(F.array_contains("domains", domain), "test").when(F.col("grouped") == "train", "train").otherwise("validation")

    return rows.join(known, "group_id").select(*rows.columns, *[split(d).alias(f"holdout_{d}") for d in domains])


def connected_groups(rows: DataFrame, vendor_holdout: bool = False, text_col: str = "narrative") -> DataFrame:
    """(record_id, group_id): connected over event, report, template, nearly equal words and, for vendor hold-outs, the vendor.

    Records with the same words are tied to the first of them, and only these firsts are compared.
    What is read of texts is written once; the texts themselves are not shuffled.
    """
    keyed = rows.withColumn("words", C.words(text_col)).select(
        "record_id", "event", F.coalesce(T.blank_to_null(F.col("report_id")), F.col("event")).alias("report"), T.vendor_template_key(F.col(text_col), F.col("vendor")).alias("template"),
        T.blank_to_null(T.vendor_key(F.col("vendor"))).alias("vendor"), F.when(F.size("words") >= C.LEAST, F.array_sort("words")).alias("words"),
    )
    keyed = materialise(keyed.withColumn("same", F.sha2(F.array_join("words", " ").cast("binary"), 256)), "keyed")
    edges = C.key_edges(keyed, ["event", "report", "template", "same", *(["vendor"] if vendor_holdout else [])])
    firsts = materialise(keyed.where("words is not null").groupBy("same").agg(F.min(F.struct("record_id", "words")).alias("x")).select("x.*"), "firsts")
    found = C.jaccard_groups(firsts, edges).withColumnRenamed("node", "record_id")
    discard(keyed, firsts)
    return rows.select("record_id").join(found, "record_id", "left").select("record_id", F.coalesce("component", "record_id").alias("group_id"))


def partition(rows: DataFrame, mode: str = "grouped", holdout: Sequence[str] = (), train_end: str | None = None, validation_end: str | None = None, seed: str = "generalisation-v1", text_col: str = "narrative") -> DataFrame:
    """(record_id, group_id, split) of rows(record_id, event, report_id, vendor, domain, report_date, narrative)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    by_value = mode in ("vendor", "template", "industry")
    if by_value and not holdout:
        raise ValueError("name what is held out")
    if mode == "temporal" and not (train_end and validation_end and train_end < validation_end):
        raise ValueError("the ends of training and validation must be in order")
    groups = connected_groups(rows, mode == "vendor", text_col)
    # what a mode asks of a record is read from it first, so that no text goes through a join
    asked = {"vendor": T.vendor_key(F.col("vendor")), "template": T.vendor_template_key(F.col(text_col), F.col("vendor")), "industry": F.col("domain"), "temporal": F.col("report_date")}
    members = materialise(groups.join(rows.select("record_id", asked[mode].alias("asked")), "record_id") if mode in asked else groups, "members")
    if mode == "temporal":
        splits = C.temporal_partition(members, "group_id", F.col("asked"), train_end, validation_end)
    elif by_value:
        held = [" ".join(v.split()).lower() for v in holdout] if mode == "vendor" else list(holdout)
        splits = C.held_out_partition(members, "group_id", F.col("asked"), held, seed)
        if splits.where("split = 'test'").isEmpty():
            raise ValueError("what is held out stands in no report")
    else:
        splits = members.groupBy("group_id").agg(F.min("record_id").alias("least")).select("group_id", C.grouped_split(F.col("least"), seed).alias("split"))
    return members.select("record_id", "group_id").join(splits, "group_id").select("record_id", "group_id", "split")


def load_splits(rows: DataFrame, domain: str, split_col: str, labels: Sequence[str]) -> DataFrame:
    """(record_id, label, split): training is what was selected; validation and test are one record of each group without a conflict of labels."""
    if split_col not in ("temporal", "grouped"):
        raise ValueError("only temporal and grouped assignments can be loaded")
    mine = rows.where(F.col("domain") == domain)
    train = mine.where(F.col("selected") & F.col("label").isin(*labels)).select("record_id", "label", F.lit("train").alias("split"))
    clean = mine.where(F.col(split_col).isin("validation", "test") & (F.col("excluded") == "") & F.col("label").isin(*labels))
    clean = clean.join(C.conflicts(mine, ["group_id"]), "group_id", "left_anti")
    rest = clean.groupBy("group_id").agg(F.min("record_id").alias("record_id"), F.min("label").alias("label"), F.min(split_col).alias("split"))
    return train.unionByName(rest.select("record_id", "label", "split"))


def load_safe_splits(records: DataFrame, assigned: DataFrame, domain: str = "construction") -> DataFrame:
    """(record_id, clean_text, label, split) of a domain's supplied splits that are free of duplicates; blank labels and texts go."""
    split = assigned.where(F.col("domain") == domain).select("record_id", F.col("official_safe").alias("split")).where(F.col("split").isin(*C.SPLITS))
    rows = records.where(F.col("domain") == domain).select("record_id", "clean_text", F.trim("label").alias("label"))
    return rows.join(split, "record_id").where("label <> '' and clean_text <> ''")


def quota_with_refill(rows: DataFrame, quotas: DataFrame, by: Sequence[str], label: str = "label", order: str = "sample_rank") -> DataFrame:
    """The rows that fill each stratum's quota (by, quota): near-equal shares of its labels, then the rest by rank from what is left.

    A stratum that has too few rows fails. Rows with their marks are written once, since both parts read them.
    """
    keys = list(by)
    some = rows.join(F.broadcast(quotas), keys)
    labels = some.groupBy(*keys, label, "quota").agg(F.count("*").alias("have"))
    whole = Window.partitionBy(*keys)
    n, place = F.count("*").over(whole), F.row_number().over(whole.orderBy(label))
    share = F.floor(F.col("quota") / n) + (place <= F.pmod(F.col("quota"), n)).cast("int")
    enough = F.sum("have").over(whole) >= F.col("quota")
    told = labels.select(*keys, label, F.when(enough, share).otherwise(F.raise_error(F.concat_ws(" ", F.lit("too few rows for"), *keys)).cast("bigint")).alias("share"))
    marked = materialise(mark_quota(some, told, [*keys, label], order=order, quota="share"), "quota")
    first, rest = (marked.where(x).drop("taken") for x in ("taken", "not taken"))
    missing = labels.join(told.drop("have"), [*keys, label]).groupBy(*keys, "quota").agg(F.sum(F.least("have", "share")).alias("had"))
    refill = mark_quota(rest.drop("quota"), missing.select(*keys, (F.col("quota") - F.col("had")).alias("left")), keys, (label, "record_id"), order, "left")
    return first.select(*rows.columns).unionByName(refill.where("taken").select(*rows.columns))


def swap_risky(selected: DataFrame, pool: DataFrame, risky: DataFrame, by: Sequence[str], order: str = "sample_rank") -> DataFrame:
    """selected with each risky record replaced by the next safe one of its stratum in the pool; a stratum without enough of these fails.

    risky(record_id); pool holds all candidates, the selected ones among them.
    """
    keys, selected = list(by), materialise(selected, "selected")
    safe = selected.join(risky, "record_id", "left_anti")
    needed = selected.join(risky, "record_id", "left_semi").groupBy(*keys).agg(F.count("*").alias("needed"))
    spare = pool.join(selected.select("record_id"), "record_id", "left_anti").join(risky, "record_id", "left_anti").join(F.broadcast(needed), keys)
    spare = materialise(mark_quota(spare.drop("needed"), needed, keys, order=order, quota="needed").where("taken").drop("taken"), "spare")
    had = spare.groupBy(*keys).agg(F.count("*").alias("had"))
    short = needed.join(had, keys, "left").where(F.coalesce("had", F.lit(0)) < F.col("needed")).select(*keys).limit(5).collect()
    if short:
        raise ValueError(f"no safe replacement in {[tuple(r) for r in short]}")
    return safe.unionByName(spare.select(*selected.columns))


def running_index(rows: DataFrame, file: str, row: str, name: str = "idx") -> DataFrame:
    """rows with their number over all files in order of (file, row), from 0; range partitions number their own rows, so no task sees a file whole."""
    return indexed(rows, file, row).withColumnRenamed("index", name)


def silver_labels(rows: DataFrame, allowed: Sequence[str], text_col: str = "clean_text") -> DataFrame:
    """rows(record_id, domain, split, group_id, text) extracted, with entities that stand at word edges, errors and review_reasons.

    errors name what an annotation must not have: overlapping spans, unknown labels, texts that
    are not at their offsets. review_reasons say why a rule's labels need a second look.
    """
    from gaugeline.operators import review
    from gaugeline.operators.extract import extract

    text = F.col(text_col)
    found = extract(rows, text_col=text_col)
    found = found.withColumn("entities", F.filter("entities", lambda e: review.aligned(text, e["start"], e["stop"])))
    n = F.size("entities")
    beside = F.zip_with(F.slice("entities", 1, F.greatest(n - 1, F.lit(0))), F.slice("entities", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b["start"] < a["stop"])
    errors = F.array_compact(F.array(
        F.when(F.exists(beside, lambda x: x), "overlap"), F.when(F.exists("entities", lambda e: ~e["label"].isin(*allowed)), "label"),
        F.when(F.exists("entities", lambda e: F.substring(text, e["start"] + 1, e["stop"] - e["start"]) != e["text"]), "offset"),
    ))
    reasons = F.array_compact(F.array(
        F.when(n == 0, "no_entities"), F.when(F.exists("entities", lambda e: e["assertion"] != "present"), "non_present_assertion"), F.when(F.exists("entities", lambda e: e["confidence"] < 0.9), "dictionary_match"),
    ))
    return found.select(*rows.columns, "entities", errors.alias("errors"), reasons.alias("review_reasons"))


def silver_report(labelled: DataFrame) -> DataFrame:
    """(split, domain, label, n) counts of records (label null) and of entities by label: one pass over both."""
    each = labelled.select("split", "domain", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.transform("entities", lambda e: e["label"]))).alias("label"))
    return each.groupBy("split", "domain", "label").agg(F.count("*").alias("n"))


def pilot_audit(rows: DataFrame) -> DataFrame:
    """Counts by domain, split and file of a pilot corpus in one pass of grouping sets; column names the grouping."""
    named = {"domain": "domain", "split": "split", "file": "file"}
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(c).alias("value")) for n, c in named.items()])
    return rows.select("sensitive", "excluded", F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("records"), F.count_if("sensitive").alias("redacted"), F.count_if(F.col("excluded") != "").alias("excluded"))
