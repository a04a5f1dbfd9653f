import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n int, sha string, row string, score double, node string, line int"
#: More names that an operator could use for itself.
CLASHES = ("ids", "mark", "marked", "part", "bits", "h", "size", "copies", "times", "below", "stays", "full", "of", "norm", "head", "a", "b", "keys", "words", "key", "__score", "__node", "__lines", "__gone", "quality", "decoded", "nth")


def words(seed: int, n: int) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randrange(2, 9))) for _ in range(n)]


def frame(spark, texts, ids=None, sources=None):
    rows = []
    for i, text in enumerate(texts):
        doc_id = ids[i] if ids else i
        source = sources[i] if sources else f"src{i % 3}"
        rows.append((doc_id, text, "en", source, None, 7, 1, "x", "y", 0.5, "z", 3))
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})


ODD = [None, "", "   \n\t ", "a", "a", "漢字 😀 é", " ".join(words(1, 6000)), "x" * 50_000, "one two three four five six", "one  two\nthree four five six"]


@pytest.fixture
def odd(spark):
    """Null, empty, blank, short, repeated, non-ASCII, very long; a null id and a repeated row; columns whose names could clash."""
    return frame(spark, [*ODD, "a", "a"], [*range(len(ODD)), None, 4])


@pytest.fixture
def empty(spark):
    return frame(spark, [])


@pytest.fixture
def tables(spark, tmp_path):
    """Writes a folder of tables as the queries read them."""

    def write(**frames):
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
