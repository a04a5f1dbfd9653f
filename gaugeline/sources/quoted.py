"""Large tables of quoted text, read by all cores: records may hold line feeds, and keep their number in the file.

Whether a line begins a record depends on the quotes of all lines before it. So each split of
a file is first summed up: how many records begin in it, and whether it ends within quotes, once
for a split that begins outside quotes and once for one that begins within. A row a split
is enough to tell how each split does begin. Then every split gives out its own
records, and only records that cross from one split to the next are put together by a shuffle.

Quotes count where a field begins; within quotes a doubled one stands for itself. Files are UTF-8
(readers.delimited reads others, in one task a file), may begin with a byte order mark, and
end their lines with LF or CR LF. Blank lines between records are no records. An empty file has
no rows. Rows with more or fewer cells than the header, and files with another header, fail the read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.scratch import materialise
from gaugeline.sources import readers

_SUMS = "path string, block long, open boolean, n long, last boolean"


def ends_open(line: str, separator: str, is_open: bool) -> bool:
    """Whether a line ends within quotes, if it begins so or not."""
    if '"' not in line:
        return is_open
    at = 0
    while True:
        if is_open:
            close = line.find('"', at)
            while close >= 0 and line[close + 1 : close + 2] == '"':
                close = line.find('"', close + 2)
            if close < 0:
                return True
            at, is_open = close + 1, False
        elif line.startswith('"', at):
            at, is_open = at + 1, True
            continue
        beyond = line.find(separator, at)
        if beyond < 0:
            return False
        at = beyond + len(separator)


def _begins(line: str) -> bool:
    return line.strip("\r﻿") != ""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _summed(separator: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two rows a split: for a beginning outside quotes and within."""
        done, now, state, n = [], None, [False, True], [0, 0]
        for batch in batches:
            for path, block, line in zip(*[c.to_pylist() for c in batch.columns]):
                if (path, block) != now:
                    if now is not None:
                        done += [(*now, bool(i), n[i], state[i]) for i in (0, 1)]
                    now, state, n = (path, block), [False, True], [0, 0]
                begins = _begins(line)
                for i in (0, 1):
                    n[i] += begins and not state[i]
                    state[i] = ends_open(line, separator, state[i])
        if now is not None:
            done += [(*now, bool(i), n[i], state[i]) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*done)) or [[]] * 5, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()))], ["path", "block", "open", "n", "last"])

    return run


def _chained(sums: pd.DataFrame) -> pd.DataFrame:
    """How each split of one file begins, and the number of records before it."""
    known = {(b, o): (n, last) for b, o, n, last in zip(sums["block"], sums["open"], sums["n"], sums["last"])}
    out, is_open, before = [], False, 0
    for block in sorted(set(sums["block"])):
        out.append((sums["path"].iloc[0], block, is_open, before))
        n, is_open = known[block, is_open]
        before += n
    return pd.DataFrame(out, columns=["path", "block", "open", "before"])


def _records(separator: str):
    names, types = ["path", "record", "piece", "raw"], (pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records of a split; piece is null for whole ones and the split's place for parts of one."""
        now, at, is_open, part, held = None, -1, False, False, []

        def close(whole: bool) -> list[tuple]:
            return [(now[0], at, None if whole and not part else now[1], "\n".join(held))] if held else []

        for batch in batches:
            out = []
            for path, block, line, begins_open, before in zip(*[c.to_pylist() for c in batch.columns]):
                if (path, block) != now:
                    out += close(not is_open)
                    now, at, is_open, part, held = (path, block), before - 1, begins_open, begins_open, []
                if not is_open:
                    out += close(True)
                    held = []
                    if not _begins(line):
                        continue
                    at, part = at + 1, False
                held.append(line.removesuffix("\r"))
                is_open = ends_open(line, separator, is_open)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 4, types)], names)
        out = close(not is_open)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 4, types)], names)

    return run


def raw_records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(path, record, raw) of every record of the files, the first of a file, its header, being 0.

    A split of a hundred megabytes has one row in the table that is broadcast, a path and three numbers.
    """
    lines = _lines(spark, path)
    sums = lines.mapInArrow(_summed(separator), _SUMS)
    begin = materialise(sums.groupBy("path").applyInPandas(_chained, "path string, block long, open boolean, before long"), "splits")
    placed = lines.join(F.broadcast(begin), ["path", "block"], "left")
    same = F.when(F.col("before").isNotNull(), F.col("before")).otherwise(F.raise_error(F.lit("the files were split otherwise when they were read again")).cast("long"))
    found = placed.select("path", "block", "value", "open", same.alias("before")).mapInArrow(_records(separator), "path string, record long, piece long, raw string")
    found = materialise(found, "records")
    parts = found.where("piece is not null").groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("piece", "raw"))).alias("parts"))
    joined = parts.select("path", "record", F.array_join(F.col("parts.raw"), "\n").alias("raw"))
    return found.where("piece is null").select("path", "record", "raw").unionByName(joined)


def table(spark: SparkSession, path: str, separator: str = ",", name: str = "source_row", file: str | None = None) -> DataFrame:
    """The files' rows as strings, with the number of each in its file: the first below the header is 2; file names a column for the path."""
    columns = readers.headers(spark, path, separator)
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    options = {"sep": separator, "escape": '"', "mode": "FAILFAST"}
    cells = F.from_csv(F.regexp_replace("raw", "^﻿", ""), schema, options)
    rows = raw_records(spark, path, separator).select("path", "record", cells.alias("cells"))
    other = F.exists(F.arrays_zip(F.array(*[F.col("cells")[c] for c in columns]).alias("a"), F.array(*[F.lit(c) for c in columns]).alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"]))
    below = F.when(F.col("record") > 0, True).when(other, F.raise_error(F.lit("a file has another header")).cast("boolean")).otherwise(False)
    return rows.where(below).select("cells.*", (F.col("record") + 1).cast("long").alias(name), *([F.col("path").alias(file)] if file else []))
