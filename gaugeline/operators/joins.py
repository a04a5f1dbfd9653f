"""Joins whose keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_above(rows: DataFrame, known: DataFrame, keys: list[str], count: str, extra: list[str], least: int) -> DataFrame:
    """rows inner-joined with `known`, one row a key, whose keys with more than `least` rows are broadcast, the others shuffled.

    `count` of known says how many rows a key has; with least at 1 / n of all rows, fewer than n keys are broadcast.
    """
    hot = known.where(F.col(count) > least).select(*[F.col(k).alias(f"hot_{k}") for k in keys], *[F.col(c).alias(f"hot_{c}") for c in extra])
    same = [F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in keys]
    marked = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), same, "left")
    big = marked.where("is_hot").select(*rows.columns, *[F.col(f"hot_{c}").alias(c) for c in extra])
    small = marked.where("is_hot is null").select(*rows.columns).join(known.where(F.col(count) <= least).select(*keys, *extra), keys)
    return big.unionByName(small.select(*rows.columns, *extra))


def join_hot(rows: DataFrame, known: DataFrame, keys: list[str], count: str, extra: list[str]) -> DataFrame:
    """join_above with the bound at 1 / (4 x partitions) of all rows."""
    total = known.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0] or 0
    return join_above(rows, known, keys, count, extra, total // (4 * partitions(rows)))
