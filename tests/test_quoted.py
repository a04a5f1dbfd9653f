import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.sources import quoted, readers


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    keys = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "300")
    spark.conf.set(keys[1], "0")
    yield
    for key, value in zip(keys, before):
        spark.conf.set(key, value)


def test_quotes_of_a_line_against_the_standard_reader():
    chance = random.Random(3)

    def ends_open(lines):
        left = iter([*lines, "after\n"])
        list(next(csv.reader(left)))
        return next(left, None) is None

    for _ in range(2000):
        line = "".join(chance.choice('aa",  "') for _ in range(chance.randrange(1, 9)))
        assert quoted.ends_open(line, ",", False) == ends_open([f"{line}\n"])
        if not quoted.ends_open(line, ",", True):
            assert not ends_open(['"\n', f"{line}\n"])
        else:
            assert ends_open(['"\n', f"{line}\n"])


def test_records_across_splits_against_the_standard_reader(spark, tmp_path, small_splits):
    chance = random.Random(5)
    cell = lambda: "".join(chance.choice(["word ", '"', "\n", ",", "é", "x" * 9, " "]) for _ in range(chance.randrange(12))) or "-"
    want = {}
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        rows = [(f"{name}{i}", cell(), cell()) for i in range(150)]
        rows[70] = (rows[70][0], "long " + "line, \"feed\"\n" * 200, "end")
        text = written([("id", "note", "more"), *rows], end)
        (tmp_path / name).write_bytes(("﻿" if name == "a.csv" else "").encode() + (text + end * 3).encode())
        want |= {r[0]: (i + 2, *r[1:]) for i, r in enumerate(rows)}
    lines = quoted._lines(spark, str(tmp_path))
    assert lines.select("path", "block").distinct().count() > 40
    got = quoted.table(spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    assert {r["id"]: (r["source_row"], r["note"], r["more"]) for r in got} == want


def test_odd_files(spark, tmp_path):
    for name, text in (("none.csv", "a,b\n"), ("blank.csv", 'a,b\n\n1,"x\n\ny"\n\n2,z')):
        (tmp_path / name).write_text(text)
    (tmp_path / "null.csv").write_bytes(b"")
    got = quoted.table(spark, f"{tmp_path}/blank.csv").orderBy("source_row").collect()
    assert [tuple(r) for r in got] == [("1", "x\n\ny", 2), ("2", "z", 3)]
    assert quoted.table(spark, f"{tmp_path}/none.csv").count() == 0
    assert quoted.raw_records(spark, f"{tmp_path}/null.csv").count() == 0
    (tmp_path / "ragged.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception):
        quoted.table(spark, f"{tmp_path}/ragged.csv").collect()
    (tmp_path / "other.csv").write_text("a,c\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        quoted.table(spark, f"{tmp_path}/{{blank,other}}.csv").collect()


def test_numbers_equal_the_one_task_reader(spark, tmp_path, small_splits):
    rows = [(str(i), f"note {i}, \"quoted\"\nsecond line" if i % 3 else f"plain {i}") for i in range(400)]
    (tmp_path / "t.csv").write_text(written([("id", "note"), *rows]))
    one = readers.numbered(readers.delimited(spark, f"{tmp_path}/t.csv")).select("id", "note", "source_row")
    all_cores = quoted.table(spark, f"{tmp_path}/t.csv")
    assert one.exceptAll(all_cores.select("id", "note", F.col("source_row"))).count() == 0 and one.count() == all_cores.count() == 400
