"""Quartile bucket digests: a fingerprint that changes little when a text does.

Byte triplets from windows of four bytes are hashed into 256 buckets. A digest
holds the length on a log scale and, for each bucket, whether its count is above
the first, second and third quartile of all counts. The difference of two
digests adds, over buckets, the distance of these codes (6 from lowest to
highest) and the bounded difference of lengths; likeness is 1 minus its share of
the largest possible difference. Equal texts have equal digests and likeness 1.

Null counts as empty. Texts of less than four bytes are padded with zero bytes, very long
ones are read whole. Repeated rows each get their digest; the order of rows with one id is
that of with_next(), and only rows that agree in id and text must stand in one block. An empty
table gives no rows, and extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm import tables

BUCKETS = 256
#: Triplets of a window of four bytes, each with its own salt.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
LENGTH_STEP, LENGTH_MOST = 8.0, 64
_CODE_DISTANCE = np.array([0, 1, 2, 6], np.int64)
MOST = int(_CODE_DISTANCE[-1]) * BUCKETS + LENGTH_MOST


def _table(salt: int) -> np.ndarray:
    """Two bytes to one, evenly: each first byte permutes the second by a rule."""
    x = np.arange(65536, dtype=np.uint64) * np.uint64(2) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(56)).astype(np.uint16)


_FIRST, _SECOND = [_table(2 * i + 1) for i in range(3)], [_table(2 * i + 2) for i in range(3)]


def digest(text: bytes) -> tuple[int, np.ndarray]:
    """(length code, code of each bucket)."""
    data = np.frombuffer(text.ljust(4, b"\0"), np.uint8).astype(np.uint16)
    counts = np.zeros(BUCKETS, np.int64)
    n = len(data) - 3
    for i, (a, b, c) in enumerate(TRIPLETS):
        head = _FIRST[i][(data[a : a + n] << 8) | data[b : b + n]]
        counts += np.bincount(_SECOND[i][(head << 8) | data[c : c + n]], minlength=BUCKETS)
    ranked = np.sort(counts)
    codes = sum((counts > ranked[BUCKETS * q // 4 - 1]).astype(np.uint8) for q in (1, 2, 3))
    return min(255, round(LENGTH_STEP * math.log1p(len(text)))), codes


def as_text(known: tuple[int, np.ndarray]) -> str:
    length, codes = known
    four = codes.reshape(-1, 4)
    return bytes([length]).hex() + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes().hex()


def from_text(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    packed = np.frombuffer(raw[1:], np.uint8)
    return raw[0], np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], 1).reshape(-1)


def difference(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> int:
    """0 to MOST."""
    codes = _CODE_DISTANCE[np.abs(a[1].astype(np.int8) - b[1].astype(np.int8))].sum()
    return int(codes) + min(LENGTH_MOST, 4 * abs(a[0] - b[0]))


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    return 1.0 - difference(a, b) / MOST


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [as_text(digest((t.as_py() or "").encode())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["id", "fingerprint"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, fingerprint string")


def _block(key: Column, tie: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many cuts are at or above (key, tie). A row is compared with every root(n)-th cut, then with those between two of them."""
    if not cuts:
        return F.lit(0)
    cuts, step = sorted(cuts, reverse=True), math.isqrt(len(cuts)) + 1
    table = lambda some: F.arrays_zip(F.lit([k for k, _ in some]).cast("array<bigint>").alias("k"), F.lit([t for _, t in some]).cast("array<bigint>").alias("t"))
    above = lambda c: (c["k"] > key) | ((c["k"] == key) & (c["t"] >= tie))
    steps = cuts[step - 1 :: step]
    whole = F.size(F.filter(table(steps), above)) if steps else F.lit(0)
    return whole * step + F.size(F.filter(F.slice(table(cuts), whole * step + 1, F.lit(step)), above))


def with_next(docs: DataFrame) -> DataFrame:
    """(block, copy, key, doc_id, text) sorted within partitions so that each row's next document follows it.

    Ids are cut into blocks at their quantiles, and an id that holds more rows than a block
    should (null ids, repeated ones) is cut again by hashes of its texts, so no task gets all rows.
    The first document of a block also stands, as a copy, behind the last of the block before.
    Null ids come last; of rows with one id those with the larger hash of the text are first in
    such an id, elsewhere the smaller text is.
    """
    n = 4 * tables.partitions(docs)
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = {(int(c), 2**63 - 1) for c in docs.select("doc_id").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n))} if n > 1 else set()
    most = F.greatest(F.lit(1), F.ceil(F.lit(docs.select("doc_id").count()) / n))
    hot = rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > most).select("key", F.ceil(F.col("rows") / most).cast("int").alias("blocks")).collect()  # n rows at most
    for key, blocks in hot:
        cuts |= {(key, 2**63 - 1)} | {(key, -(2**63) + i * 2**64 // blocks) for i in range(1, blocks)}
    tie = F.when(F.col("key").isin([r["key"] for r in hot]), F.xxhash64("text")).otherwise(F.lit(0)) if hot else F.lit(0)
    rows = rows.withColumn("tie", tie.cast("long")).withColumn("block", _block(F.col("key"), F.col("tie"), list(cuts)))
    heads = rows.groupBy("block").agg(F.max(F.struct("key", "tie")).alias("head"))  # one row a block
    before = F.coalesce(F.lag("block").over(Window.orderBy("block")), F.max("block").over(Window.partitionBy()))
    heads = heads.select(F.col("head.key").alias("key"), F.col("head.tie").alias("tie"), before.alias("behind"))
    own, again = (F.struct(F.col(c).alias("block"), F.lit(i).alias("copy")) for i, c in enumerate(("block", "behind")))
    where = F.when(F.col("behind").isNotNull(), F.array(own, again)).otherwise(F.array(own))
    placed = rows.join(F.broadcast(heads), ["key", "tie"], "left").select("key", "tie", "doc_id", "text", F.explode(where).alias("p"))
    placed = placed.select("p.block", "p.copy", "key", "doc_id", "text", "tie")
    return placed.repartition(tables.partitions(docs), "block").sortWithinPartitions("block", "copy", F.desc("key"), F.desc("tie"), "text")


def op2_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def told(now, after) -> tuple:
        _, _, doc_id, text, own = now
        k = len(text) // 3
        edited = (text[: len(text) - k] + after[3][:k]).encode()
        other = digest(edited)
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, after[4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for block, copy, doc_id, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)]):
                row = block, copy, doc_id, text, digest(text.encode())
                if now is not None and not now[1]:
                    out.append(told(now, row))
                now = row
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 7, types)], names)
        # the last row of each block is a copy, so nothing is left over

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in schema.split(", ")]
    return with_next(tables.documents(spark, sf_dir).select("doc_id", "text")).mapInArrow(run, schema)
