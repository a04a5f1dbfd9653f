"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed hash. Tokens are summed by source and hash bucket; the
bucket where a source's budget ends is split into finer buckets, and so on until
the hash is used up; then a filter on the hash takes the mix. Nothing is sorted
by document, and a smaller budget's documents are all in a larger budget's mix.

Sources stand in code-point order, null last, and weigh 3, 1, 2, repeating. They
share 150 % of all sizes by weight; a target stops at twice its source's size and
the excess is shared again by weight. A budget of r times a source's size takes
every document floor(r) times and the rest by threshold, MOST times at most. Documents
of size 0 and null texts take 0 words. Repeated rows are documents of their own with one
hash; rows of one id, or of none, with different texts have different hashes. Very long
texts count whole, an empty table gives no rows, extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm import tables
from gaugeline.scratch import materialise

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: The hash has LEVELS times BITS bits.
LEVELS, BITS = 4, 12
#: One row for each source is broadcast up to this many sources and joined by shuffle beyond.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{tables.SPACE}]+")).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """48 bits from SHA-256 of the id as text and the text's MD5, so that SQL elsewhere finds the same."""
    said = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.sha2(said.cast("binary"), 256)
    return F.conv(F.substring(digest, 1, LEVELS * BITS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    With sources in order of the level at which they are full, the shares of the
    others follow from running sums: this is where sharing again by weight ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    full = F.col("source_size") * F.lit(float(most))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    known = totals.withColumn("weight", weight).withColumn("full", full).withColumn("level", F.col("full") / F.col("weight"))
    known = known.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(everything))
    rest = F.col("budget") - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    open_weight = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    known = known.withColumn("water", rest / open_weight).withColumn("open", F.col("level") > F.col("water"))
    found = F.min(F.when(F.col("open"), F.struct("level", "water"))).over(everything)["water"]
    return known.select("source", "source_size", F.least("full", F.coalesce(F.col("weight") * found, F.col("full"))).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, times, below): take a document `times` times, and once more if its hash is below."""
    times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(MOST)))).otherwise(F.lit(0))
    state = goals.withColumn("times", times.cast("int")).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")).withColumn("at", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * BITS
        prefix = F.shiftright("h", shift)
        rows = sized if level == 0 else _with(sized, state.select("source", "at")).where(F.shiftright("h", shift + BITS) == F.col("at"))
        sums = rows.groupBy("source", prefix.alias("bucket")).agg(F.sum("size").alias("words"))
        up_to = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        fits = sums.withColumn("up_to", up_to)
        fits = _with(fits, state.select("source", "budget")).where(F.col("up_to") <= F.col("budget"))
        last = fits.groupBy("source").agg(F.max("bucket").alias("bucket"), F.max("up_to").alias("used"))
        first = F.col("at") * F.lit(1 << BITS)
        joined = state.join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        state = materialise(
            joined.withColumn("at", F.coalesce(F.col("bucket") + 1, first)).withColumn("budget", F.col("budget") - F.coalesce("used", F.lit(0))).drop("bucket", "used"), "mixing-level"
        )
    return state.select("source", "source_size", "target", "times", F.col("at").alias("below"))


def _with(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Join what is known of each source; null is a source too."""
    other = by_source.withColumnRenamed("source", "s")
    if by_source.count() <= BROADCAST_SOURCES:
        other = F.broadcast(other)
    return rows.join(other, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, source, size, h) of each row, and the thresholds of each source."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(tables.text_of(text_col)).alias("size"), hash_of(F.col(id_col), F.col(text_col)).alias("h"))
    sized = materialise(sized, "mixing-sizes")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    return sized, thresholds(sized, materialise(goals, "mixing-goals"))


def copies_of(h: str = "h") -> Column:
    """How often a row is taken; never above MOST, also where all of a source is taken and rows of size 0 pass any threshold."""
    return F.least(F.col("times") + (F.col(h) < F.col("below")).cast("int"), F.lit(int(MOST)))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of the mix with the columns of docs; a row that is taken twice stands twice."""
    _, limits = plan(docs, id_col, source_col, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(source_col).alias("source"), hash_of(F.col(id_col), F.col(text_col)).alias("h"))
    chosen = _with(rows, limits).select("row", copies_of().alias("copies")).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, limits = plan(tables.documents(spark, sf_dir))
    return _with(sized, limits).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies_of()).cast("long").alias("taken"))


OP10_SQL = r"""
with recursive
d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
      ('0x' || substr(sha256(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 12))::bigint as h from documents),
t as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight, 2.0::double * source_size as full_at from t),
b as (select *, full_at / weight as level, 1.5::double * sum(source_size) over () as budget, sum(weight) over () as all_weight from w),
r as (select *, (budget - coalesce(sum(full_at) over (order by level, source nulls last rows between unbounded preceding and 1 preceding), 0))
      / (all_weight - coalesce(sum(weight) over (order by level, source nulls last rows between unbounded preceding and 1 preceding), 0)) as water from b),
f as (select min_by(water, level) as water from r where level > water),
g as (select source, source_size, least(full_at, coalesce(weight * (select water from f), full_at)) as target from r),
k as (select *, case when source_size > 0 then least(floor(target / source_size), 2)::bigint else 0 end as times from g),
u as (select d.doc_id, d.size, k.source_size, k.target, k.times,
      sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row) as up_to
      from d join k on d.source is not distinct from k.source)
select doc_id, size, source_size, target,
       (size * (least(2, times + case when up_to <= target - times * source_size then 1 else 0 end)))::bigint as taken from u
"""
