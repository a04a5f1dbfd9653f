"""Names and small helpers common to the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators.joins import join_hot, partitions
from gaugeline.session import spread, table

__all__ = ["SPACE", "documents", "fresh", "join_hot", "marked", "partitions", "remainder", "split", "text_of", "without"]

#: The white space of all contracts, as it stands in a regular expression.
SPACE = r"\x20\x09-\x0D"
#: Bits of the marks that tell which rows an exact join needs, as a power of two: 131,072 longs, whatever the corpus.
MARKS = 23


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def text_of(column: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`: the folds of the contracts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def marked(rows: DataFrame, mark: Column, known: DataFrame) -> DataFrame:
    """rows with a column `marked`: false only where no row of known (mark long) has this mark.

    The marks are 2 ** MARKS bits in a broadcast table of longs, built by Spark.
    """
    place = F.pmod(F.col("mark"), F.lit(1 << MARKS))
    bits = known.select(F.shiftright(place, 6).alias("part"), F.expr(f"shiftleft(1L, cast(pmod(mark, {1 << MARKS}) & 63 as int))").alias("bit"))
    bits = F.broadcast(bits.groupBy("part").agg(F.bit_or("bit").alias("bits")))
    here = rows.withColumn("mark", F.pmod(mark, F.lit(1 << MARKS))).withColumn("part", F.shiftright("mark", 6)).join(bits, "part", "left")
    hit = F.coalesce(F.getbit("bits", F.expr("cast(mark & 63 as int)")), F.lit(0)) == 1
    return here.select(*rows.columns, hit.alias("marked"))


def split(docs: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose id is not among ids (id, each once), and those whose id is; all their columns and no others.

    Rows that the marks clear are never shuffled; of the others an exact join decides.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = marked(docs.select(row, F.col(id_col).alias("id")), F.xxhash64("id"), ids.select(F.xxhash64("id").alias("mark")))
    clear, other = rows.where("not marked").select("row"), rows.where("marked").select("row", "id")
    same = F.col("id").eqNullSafe(F.col("of"))
    ids = ids.select(F.col("id").alias("of"))
    out = clear.unionByName(other.join(ids, same, "left_anti").select("row"))
    return out.select("row.*"), other.join(ids, same, "left_semi").select("row.*")


def without(docs: DataFrame, keep: str, *names: str) -> DataFrame:
    """docs without the columns that an operator is about to write; `keep` is what it reads and may not be among them."""
    taken = {n.lower() for n in names if n}
    if keep.lower() in taken:
        raise ValueError(f"{keep} is read and cannot be written")
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    known = {c.lower() for c in docs.columns}
    while name.lower() in known:
        name += "_"
    return name
