"""Corpus preparation: keys, connected groups, leak-free splits, deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from gaugeline.functions import text as T
from gaugeline.operators.graph import connected_components
from gaugeline.operators.order import mark_quota
from gaugeline.scratch import discard, materialise

SPLITS = ("train", "validation", "test")


def split_by_score(score: Column, train: float = 0.7, validation: float = 0.85) -> Column:
    return F.when(score < train, "train").when(score < validation, "validation").otherwise("test")


def grouped_split(group: Column, seed: str, train: float = 0.7, validation: float = 0.85) -> Column:
    return split_by_score(T.unit_hash(F.concat(F.lit(f"{seed}:"), group)), train, validation)


def period(year: Column) -> Column:
    # Years of the temporal policy.
    return F.when(year == 2026, "demo").when(year == 2025, "test").when(year == 2024, "validation").when(year.between(2010, 2023), "train").otherwise("quarantine")


def sample_rank(record_id: Column, seed: str = "sample-v1") -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), record_id).cast("binary"), 256)


def index(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row a record: exact and template keys, words, flags, exclusion, sample rank; one scan and no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    clean = T.prepare(T.nfkc(text))
    rows = docs.select(F.col(id_col).cast("string").alias("record_id"), *carry, clean.alias("c"))
    return rows.select(
        "record_id", *carry, T.exact_key(F.col("c.text")).alias("exact"), T.template_key(F.col("c.text")).alias("template"), T.token_count(F.col("c.text")).alias("words"), F.col("c.sensitive").alias("sensitive"),
        F.when(F.col("c.text") == "", "empty_narrative").when(~F.replace(F.col("c.text"), F.lit(T.REDACTED), F.lit("")).rlike("[a-zA-Z]"), "no_alphabetic_narrative").otherwise("").alias("excluded"), sample_rank(F.col("record_id")).alias("sample_rank"),
    )


def key_edges(rows: DataFrame, keys: Sequence[str], id_col: str = "record_id") -> DataFrame:
    """Each record with the first record of each of its keys: a star for a key, never all pairs."""
    long = rows.select(F.col(id_col).alias("b"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys])).alias("k"))
    long = long.where("k.key is not null and k.key <> ''").select("b", "k.kind", "k.key")
    first = long.groupBy("kind", "key").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
    return long.join(first, ["kind", "key"]).select("a", "b").where("a <> b")


def groups(rows: DataFrame, keys: Sequence[str], id_col: str = "record_id") -> DataFrame:
    """(record_id, group_id): connected over shared keys; the smallest id names the group."""
    found = connected_components(key_edges(rows, keys, id_col))
    return rows.select(F.col(id_col).alias("record_id")).join(found.withColumnRenamed("node", "record_id"), "record_id", "left").select("record_id", F.coalesce("component", "record_id").alias("group_id"))


def consistent(rows: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """(group, name): the group's one value, or quarantine if it has none or several."""
    return rows.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select(group, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("quarantine").alias(name))


def conflicts(rows: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Groups with several labels: one pass of min and max, no distinct lists."""
    return rows.where(F.col(label) != "").groupBy(*keys).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi").select(*keys)


def representatives(rows: DataFrame, by: Sequence[str], order: str = "sample_rank") -> DataFrame:
    """The first row of each group by rank: a struct minimum combines before the shuffle, a window would not."""
    row = F.struct(order, "record_id", *[F.struct(*rows.columns).alias("row")])
    return rows.groupBy(*by).agg(F.min(row).alias("m")).select("m.row.*")


def largest_remainder(strata: DataFrame, budget: int, by: Sequence[str], count: str = "n") -> DataFrame:
    """strata with quota: proportional to count, what is left goes to the largest remainders, ties in order of the keys."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = strata.withColumn("total", F.sum(count).over(everything))
    left = F.least(F.lit(budget), F.col("total"))
    rows = rows.withColumn("quota", F.expr(f"least({budget}, total) * {count} div total")).withColumn("rest", F.pmod(left * F.col(count), F.col("total")))
    rows = rows.withColumn("leftover", left - F.sum("quota").over(everything)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("rest"), *by)))
    return rows.select(*by, count, (F.col("quota") + (F.col("place") <= F.col("leftover")).cast("int")).alias("quota"))


def near_equal(strata: DataFrame, per_domain: int, domain: str, label: str) -> DataFrame:
    """strata with quota: the same for every label of a domain, the first ones get one more."""
    whole = Window.partitionBy(domain)
    place = F.row_number().over(whole.orderBy(label))
    n = F.count("*").over(whole)
    return strata.withColumn("quota", F.floor(F.lit(per_domain) / n) + (place <= F.pmod(F.lit(per_domain), n)).cast("int"))


def take_quota(rows: DataFrame, quotas: DataFrame, by: Sequence[str], order: str = "sample_rank") -> DataFrame:
    """Of each stratum the first rows by rank."""
    return mark_quota(rows, quotas, by, order=order).where("taken").drop("taken")


def training_sample(rows: DataFrame, group: str, strata: Sequence[str], budget: int) -> DataFrame:
    """Of rows(record_id, label, split, sample_rank): representatives of training groups whose labels agree everywhere, by proportional quotas of the strata."""
    clean = rows.join(conflicts(rows, [group]), group, "left_anti").where("split = 'train'")
    one = representatives(clean, [group])
    quotas = largest_remainder(one.groupBy(*strata).agg(F.count("*").alias("n")), budget, list(strata))
    return take_quota(one, quotas, list(strata))


#: Distinct words that a record has at least to be compared with others.
LEAST = 8


def words(text_col: str) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z]+"), F.lit(0)))


def token_sets(rows: DataFrame, text_col: str, id_col: str = "record_id", least: int = LEAST) -> DataFrame:
    return rows.select(F.col(id_col).alias("record_id"), words(text_col).alias("words")).where(F.size("words") >= least)


#: Counters of hashed words that tell rare words from common ones, and longs of a set's bitmap. No result depends on them.
COUNTERS, LONGS = 1 << 14, 16


def _counter(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(COUNTERS)).cast("int")


@F.pandas_udf(ArrayType(LongType()))
def _bitmap(hashes: pd.Series) -> pd.Series:
    """LONGS longs whose bits say whether an odd number of words falls on each; sets that differ in k words differ in at most k bits."""
    bits, out = 64 * LONGS, []
    for at in range(0, len(hashes), 1024):
        part = [np.asarray(x, np.int64) for x in hashes.iloc[at : at + 1024]]
        cell = np.repeat(np.arange(len(part)) * bits, [len(x) for x in part]) + np.concatenate(part) % bits
        odd = np.bincount(cell, minlength=len(part) * bits).astype(np.uint8) & 1
        out.extend(np.packbits(odd.reshape(len(part), bits), axis=1).view(np.int64))
    return pd.Series(out, hashes.index)


def jaccard_candidates(sets: DataFrame, similarity: float = 0.9) -> DataFrame:
    """(a, b) of all pairs that reach the similarity, and of some that do not; a < b.

    Words are ordered by rarity; matching sets share one of their first
    n - ceil(similarity n) + 1, so only these are join keys. Rarity is told by a fixed number of
    hashed counters that every task gets, so a set's first words are found in its own row and
    no other words are shuffled. Bitmaps leave out pairs that differ in too many words before texts are asked for.
    """
    counted = sets.select(F.explode("words").alias("w")).groupBy(_counter(F.col("w")).alias("at")).agg(F.count("*").cast("int").alias("n"))
    every = sets.sparkSession.range(COUNTERS).select(F.col("id").cast("int").alias("at")).join(counted, "at", "left")
    counts = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("counts"))
    size = F.size("words")
    ranked = F.array_sort(F.transform("words", lambda w: F.struct(F.get("counts", _counter(w)).alias("n"), w.alias("w"))))
    first = F.slice(ranked, F.lit(1), (size - F.ceil(F.lit(similarity) * size - 1e-9) + 1).cast("int"))
    prefix = sets.crossJoin(F.broadcast(counts)).select("record_id", size.alias("size"), _bitmap(F.transform("words", lambda w: F.xxhash64(w, F.lit(1)))).alias("bits"), first.alias("first"))
    prefix = prefix.select("record_id", "size", "bits", F.explode_outer("first").alias("x")).where("x.n > 1").select("record_id", "size", "bits", F.col("x.w").alias("w"))
    x, y = (prefix.select("w", F.col("record_id").alias(s), F.col("size").alias(f"n{s}"), F.col("bits").alias(f"bits{s}")) for s in "ab")
    unlike = sum((F.bit_count(F.get("bitsa", F.lit(i)).bitwiseXOR(F.get("bitsb", F.lit(i)))) for i in range(LONGS)), F.lit(0))
    # sets of na and nb words with so many in common differ in na + nb less twice these
    near = (F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb")) & (unlike <= (F.col("na") + F.col("nb")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6)
    return x.join(y, "w").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def jaccard_verified(pairs: DataFrame, sets: DataFrame, similarity: float = 0.9) -> DataFrame:
    """(a, b, jaccard) of those pairs that reach the similarity."""
    wa, wb = (sets.select(F.col("record_id").alias(s), F.col("words").alias(f"w{s}")) for s in "ab")
    both = F.size(F.array_intersect("wa", "wb"))
    full = pairs.join(wa, "a").join(wb, "b").withColumn("jaccard", both / (F.size("wa") + F.size("wb") - both))
    return full.where(F.col("jaccard") >= similarity).select("a", "b", "jaccard")


def jaccard_pairs(sets: DataFrame, similarity: float = 0.9) -> DataFrame:
    """(a, b, jaccard) of all pairs that reach the similarity, exactly."""
    return jaccard_verified(jaccard_candidates(sets, similarity), sets, similarity)


def jaccard_groups(sets: DataFrame, edges: DataFrame, similarity: float = 0.9) -> DataFrame:
    """(node, component): connected over edges(a, b) and over all pairs of sets that reach the similarity.

    Each record's first candidate is compared before the others; of these only pairs that are not
    connected by then, so texts of a family of near copies meet a few others each, not all of them.
    """
    candidates = materialise(jaccard_candidates(sets, similarity), "candidates")
    lead = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    known = materialise(edges.unionByName(jaccard_verified(lead, sets, similarity).select("a", "b")), "edges")
    found = connected_components(known)
    at = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    apart = candidates.join(lead, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    more = jaccard_verified(apart.select("a", "b"), sets, similarity).select("a", "b")
    again = materialise(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "edges")
    out = connected_components(again)
    discard(candidates, known, again)
    return out


def temporal_partition(rows: DataFrame, group: str, date: Column, train_end: str, validation_end: str) -> DataFrame:
    """(group, split): by period if all members agree, else quarantine; undated members quarantine."""
    when = F.when(T.blank_to_null(date).isNull(), "quarantine").when(date <= train_end, "train").when(date <= validation_end, "validation").otherwise("test")
    return consistent(rows, group, when, "split")


def held_out_partition(rows: DataFrame, group: str, value: Column, held: Sequence[str], seed: str) -> DataFrame:
    """(group, split): test if a member has a held-out value, else train or validation by hash of the smallest id."""
    found = rows.groupBy(group).agg(F.max(value.isin(*held)).alias("held"), F.min("record_id").alias("least"))
    return found.select(group, F.when(F.col("held"), "test").when(T.unit_hash(F.concat(F.lit(f"{seed}:"), "least")) < 0.8, "train").otherwise("validation").alias("split"))


def leaks(rows: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """How many groups stand in several splits; must be 0."""
    return rows.groupBy(group).agg(F.min(split).alias("lo"), F.max(split).alias("hi")).agg(F.count_if(F.col("lo") != F.col("hi")).alias("leaking_groups"))


def upper_median(rows: DataFrame, value: str, by: str) -> DataFrame:
    """count, mean, upper median, least and most by group, from counts of equal values: no sort of all rows."""
    counted = rows.groupBy(by, value).agg(F.count("*").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy(by).orderBy(value))
    total = F.sum("c").over(Window.partitionBy(by))
    placed = counted.withColumns({"up_to": up_to, "total": total}).withColumn("at", F.floor(F.col("total") / 2) + 1)
    hit = F.when((F.col("up_to") >= F.col("at")) & (F.col("up_to") - F.col("c") < F.col("at")), F.col(value))
    return placed.groupBy(by).agg(
        F.sum("c").alias("count"), F.bround(F.sum(F.col(value) * F.col("c")) / F.sum("c"), 4).alias("mean"), F.max(hit).alias("median"), F.min(value).alias("least"), F.max(value).alias("most")
    )
