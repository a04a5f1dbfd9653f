"""Exact dedup by progressive refinement: length, then a prefix hash, then the full hash.

Texts are equal when identical after replacing each run of ASCII white space by
one space; null counts as empty. Of equal texts the row with the smallest doc_id
stays (a null id is larger than all others; of repeated rows with one id, one stays).
Empty texts are equal to each other, very long ones are compared whole. An empty
table gives no rows. Extra columns, whatever their names, are kept as they are.

Every step groups narrow rows with partial aggregation, and joins them so that
adaptive execution can split a hot key: a group that holds a third of all rows never
meets in one task, and texts are never shuffled. Which texts length and prefix leave
undecided is told by marks of fixed size: a mark set in vain costs one full hash
and changes nothing, for the full hash decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import tables
from gaugeline.scratch import materialise

PREFIX = 256


def normalised(text: Column) -> Column:
    """Only runs that are not already one space are rewritten."""
    return F.regexp_replace(text, rf"[\x09-\x0D][{tables.SPACE}]*|\x20[{tables.SPACE}]+", " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = normalised(tables.text_of(text_col))
    return (
        docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
        .select("id", "norm", F.length("norm").alias("n"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("head"))
    )


def _survivors(keyed: DataFrame) -> DataFrame:
    """(n, head) of the groups that length and prefix leave undecided; full texts are not hashed here."""
    counted = materialise(keyed.groupBy("n", "head").agg(F.count("*").alias("rows")), "exact-keys")
    lengths = counted.groupBy("n").agg(F.sum("rows").alias("of_length")).where("of_length > 1")
    return counted.join(lengths, "n").where("rows > 1").select("n", "head")


def _hashed(keyed: DataFrame, digest: bool) -> DataFrame:
    """The rows of keyed with marked, whether length and prefix leave a text undecided, and digest, the full hash of such texts, or of all if asked for."""
    left = materialise(_survivors(keyed), "exact-survivors")
    rows = tables.marked(keyed, F.xxhash64("n", "head"), left.select(F.xxhash64("n", "head").alias("mark")))
    full = F.sha2(F.col("norm").cast("binary"), 256)
    return rows.withColumn("digest", full if digest else F.when(F.col("marked"), full)).drop("norm")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, sha (null for a text that no step hashed), digest (sha, of all texts if asked for).

    Only texts that length and prefix leave undecided are grouped, by their full hashes.
    """
    keys = ["id", "digest", "marked"]
    hashed = _hashed(_keyed(docs, id_col, text_col), digest).groupBy(*keys).agg(F.count("*").alias("copies"))
    hashed = materialise(hashed, "exact-hashes")
    groups = hashed.where("marked").groupBy(F.col("digest").alias("sha")).agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = materialise(groups.where("group_size > 1").withColumnRenamed("sha", "of"), "exact-groups")
    # of groups above 1 / (4 x partitions) of the rows there are fewer than 4 x partitions: these are broadcast, the others joined by shuffle
    hot_size = hashed.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] // (4 * tables.partitions(docs))
    hashed = hashed.withColumn("sha", F.when(F.col("marked"), F.col("digest")))
    alone, asked = hashed.where("not marked"), hashed.where("marked")  # only the latter are joined: the others have no key
    same, found = F.col("sha") == F.col("of"), [*hashed.columns, "of", "keep_id", "group_size"]
    marked = asked.join(F.broadcast(groups.where(F.col("group_size") > hot_size)), same, "left")
    rest = marked.where("of is null").select(*hashed.columns).join(groups.where(F.col("group_size") <= hot_size), same, "left")
    told = marked.where("of is not null").select(*found).unionByName(rest.select(*found)).unionByName(alone, allowMissingColumns=True)
    lone = F.col("of").isNull()
    told = told.select(
        "id", F.when(lone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(lone, F.col("copies")).otherwise(F.col("group_size")).alias("group_size"), "sha", "digest",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth"),
    )
    return told.select("id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "sha", "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns and no others.

    A row that length and prefix leave alone is never hashed in full; rows whose id no
    dropped row has are never shuffled.
    """
    told = exact_groups(docs, id_col, text_col)
    gone = materialise(told.groupBy("id", "sha").agg(F.max("kept").alias("stays"), F.count("*").alias("copies")).where("not stays or copies > 1"), "exact-fate")
    kept, doubtful = tables.split(docs, id_col, gone.select("id").distinct())
    repeated = told.join(gone.select(F.col("id").alias("of")).distinct(), F.col("id").eqNullSafe(F.col("of")), "left_semi").where("kept").select("id", "sha")
    repeated = materialise(repeated, "exact-repeated")
    if repeated.isEmpty():
        return kept
    # of rows whose id stands several times, one of each text that stays
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    norm = normalised(F.coalesce(F.col("row").getField(text_col), F.lit("")))
    rows = doubtful.select(row).select("row", F.col("row").getField(id_col).alias("id"), F.sha2(norm.cast("binary"), 256).alias("full"))
    rows = rows.groupBy("id", "full").agg(F.first("row").alias("row"))
    stay = repeated.select(F.col("id").alias("of"), "sha")
    rows = rows.join(stay, F.col("id").eqNullSafe(F.col("of")) & (F.col("sha").isNull() | (F.col("sha") == F.col("full"))), "left_semi")
    return kept.unionByName(rows.select("row.*"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(tables.documents(spark, sf_dir), digest=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = r"""
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from n group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from n join g using (text_sha256)
"""
