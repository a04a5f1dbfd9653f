"""Periodic runs of words: stretches that repeat a shorter stretch at least twice.

Words of a text are numbered, and the bits of the numbers become planes, one big integer a
bit. For a lag q, each plane is XORed with itself shifted by q and the mismatches are ORed:
a zero says that words q apart are equal. ANDs with doubling shifts leave the places where a
long enough stretch without mismatch begins. A text's lags end at the longest stretch of
places whose next six words come again later, since a run of period q has such a stretch of
q - 5 places at least; so a text without repetition is told by one pass.

Work on a text grows with its lags times its words / 64. Texts are independent: nothing is
shuffled, and a lost task is run anew.

Odd rows: a null or empty text, or one of fewer than LEAST words, has no run and collapses
to its words joined by one space; repeated rows are worked on alike, very long texts whole.
An empty table gives no rows. Columns named like the new ones are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from gaugeline.llm import tables, textkit

#: Words that a run has at least, beside twice its period.
LEAST = 12
#: Words q apart that are equal in a run of any period, one after the other: the least of max(LEAST - q, q).
SURE = LEAST // 2
RUN = StructType([StructField(x, LongType()) for x in ("start", "length", "period")])
_RUN = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers by first appearance."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def longest_lag(ids: np.ndarray) -> int:
    """No run has a greater period; 0 if there is no run. Hashes that collide can only raise it."""
    places = len(ids) - SURE + 1
    if len(ids) < LEAST:
        return 0
    h = np.zeros(places, np.uint64)
    for k in range(SURE):
        h = textkit.mix(h + ids[k : k + places].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    again = np.zeros(places + 2, bool)
    again[order[:-1][h[order[:-1]] == h[order[1:]]] + 1] = True
    edges = np.flatnonzero(again[1:] != again[:-1])
    longest = int((edges[1::2] - edges[::2]).max(initial=0))
    return min(len(ids) // 2, longest + SURE - 1) if longest else 0


def planes(ids: np.ndarray) -> list[int]:
    """A big integer for each bit of the numbers: bit i is that of word i."""
    bits = int(ids.max(initial=0)).bit_length()
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(bool), bitorder="little").tobytes(), "little") for b in range(bits)]


def _places(x: int) -> np.ndarray:
    raw = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def stretches(same: int, least: int) -> list[tuple[int, int]]:
    """(first, past the last) of the stretches of at least so many one bits."""
    have = 1
    while have < least and same:
        step = min(have, least - have)
        same &= same >> step
        have += step
    if not same:
        return []
    return list(zip(_places(same & ~(same << 1)).tolist(), (_places(same & ~(same >> 1)) + least).tolist()))


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period."""
    ids = numbered(words)
    n, bits, spans, found = len(ids), planes(ids), set(), []
    for q in range(1, longest_lag(ids) + 1):
        differ = 0
        for plane in bits:
            differ |= plane ^ plane >> q
        for first, past in stretches(~differ & (1 << n - q) - 1, max(LEAST - q, q)):
            # a stretch whose smallest period is smaller is the run of that period, whole: it has been found
            if (span := (first, past + q)) not in spans:
                spans.add(span)
                found.append((first, past + q - first, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.cumsum(edges)[:-1] == 0
    return b" ".join(w for w, k in zip(words, kept.tolist()) if k)


def find_runs(docs: DataFrame, text_col: str = "text", runs: str = "runs", text: str = "collapsed") -> DataFrame:
    """The rows of docs with their runs, and with the text that is left when each run keeps its first period only."""
    docs = tables.without(docs, text_col, runs, text)
    at = docs.columns.index(text_col)
    extra = [StructField(runs, ArrayType(RUN)), StructField(text, StringType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in textkit.chunks(whole.column(at), 1 << 22):
                batch = whole.slice(lo, hi - lo)
                found, left = [], []
                for value in batch.column(at):
                    words = (value.as_py() or "").encode().split()  # bytes are split at the white space of the contracts
                    here = runs_of(words)
                    found.append(here)
                    left.append(collapsed(words, here).decode())
                rows = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
                offsets = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(left, pa.string())], [*batch.schema.names, runs, text])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, *extra]))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: of every tenth document by hash, the words from a place on repeat a stretch from there.

    The place is g % n and the stretch 1 + (n - place) / (3 + g % 8) words, for g a tenth of
    the hash and n words. A null id has no hash: its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = tables.text_of()
    words = F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(f"[^{tables.SPACE}]+"), F.lit(0)))
    rows = docs.select("doc_id", text.alias("text"), F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    changed = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), and digests of all runs and of the collapsed text."""
    found = find_runs(planted(tables.documents(spark, sf_dir)))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.selectExpr("doc_id", "n_runs", "-r.col2 as start", "r.length as length", "-r.col3 as period", "(1000 * r.length) div -r.col3 as exponent_milli", "runs_sha256", "collapsed_sha256")
