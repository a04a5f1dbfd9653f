"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is described by damped counts of its words (lower-cased, hashed into WORDS
terms), of its character-class trigrams (letters by case, digits, spaces, line ends,
kinds of punctuation), and by terms for its surface: shares of repeated words and
lines, word length, size. Counts are scaled and projected on the leading singular
vectors of a labelled sample of at most SAMPLE rows of each label, chosen by hash.
Every document's cosine with every sample vector is computed exactly, in blocks; the
NEAREST ones vote with their similarity as weight. The vectors are of fixed number and
width, so they are broadcast; the sample's counts are sparse.

Null and empty texts have the terms of the smallest size and are voted on as any
other. With no labels all scores are 0.5. Repeated rows score alike; of sample rows
with one id the smallest counts. Very long texts are read whole, an empty table gives
no rows. Extra columns stay; one of the score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gaugeline.llm import tables, textkit
from gaugeline.scratch import materialise
from gaugeline.session import table

SAMPLE = 2048
RANK = 48
NEAREST = 15
POWER = 4
WORDS = 4096
#: Weight of a word's term beside one of form, in the vectors.
WORD_WEIGHT = 0.5
_LEVELS = 16
_SURFACE = 5


def _classes() -> np.ndarray:
    found = np.full(256, 12, np.int64)
    for i in range(256):
        c = chr(i)
        if i >= 128:
            found[i] = 13
        elif c.islower():
            found[i] = 0
        elif c.isupper():
            found[i] = 1
        elif c.isdigit():
            found[i] = 2
    for k, some in enumerate((" \t\r\f\v", "\n", ".,;:", "!?", "|", "*", "#", "$", "%&")):
        for c in some:
            found[ord(c)] = 3 + k
    return found


CLASSES = _classes()
TRIGRAMS = 16**3
FORM = TRIGRAMS + _SURFACE * _LEVELS
TERMS = FORM + WORDS


def _repeats(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: how many keys, and how many different ones."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(k), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return np.bincount(row, minlength=n), np.bincount(r[new], minlength=n)


def counts(texts: pa.Array) -> np.ndarray:
    """Damped counts of the terms, a row for each text."""
    data, offsets = textkit.buffers(texts)
    n, size = len(texts), np.diff(offsets)
    out = np.zeros((n, TERMS), np.float32)
    row = np.repeat(np.arange(n), size)
    c = CLASSES[data]
    if len(c) > 2:
        same = row[2:] == row[:-2]
        key = (row[2:] * TRIGRAMS + (c[:-2] << 8 | c[1:-1] << 4 | c[2:]))[same]
        out[:, :TRIGRAMS] = np.bincount(key, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    starts, ends, first = textkit.words(data, offsets)
    words = textkit.word_hashes(data, starts, ends)
    of = np.repeat(np.arange(n), np.diff(first))
    many, different = _repeats(of, words, n)
    again = np.zeros(n)
    if len(words) > 1:
        again = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=n)
    line_break = np.zeros(256, bool)
    line_break[10] = True
    ls, le, lf = textkit.words(data, offsets, line_break)
    lines, different_lines = _repeats(np.repeat(np.arange(n), np.diff(lf)), textkit.word_hashes(data, ls, le), n)
    length = np.bincount(of, (ends - starts).astype(float), n) / np.maximum(many, 1)
    shares = (1 - different / np.maximum(many, 1), again / np.maximum(many, 1), 1 - different_lines / np.maximum(lines, 1), np.minimum(length / 32, 1))
    for k, share in enumerate(shares):  # each level up to the share counts, so that near shares are alike
        level = np.arange(_LEVELS)[None, :] < np.round(share * _LEVELS)[:, None]
        out[:, TRIGRAMS + k * _LEVELS : TRIGRAMS + (k + 1) * _LEVELS] = level * np.sqrt(size)[:, None]
    level = np.arange(_LEVELS)[None, :] <= np.log2(1 + size)[:, None]  # the lowest level stands for every text, also an empty one
    out[:, FORM - _LEVELS : FORM] = level
    plain, edges = textkit.buffers(pc.utf8_lower(texts))
    starts, ends, first = textkit.words(plain, edges, textkit.NOT_ALNUM)
    of = np.repeat(np.arange(n), np.diff(first))
    key = of * WORDS + (textkit.word_hashes(plain, starts, ends) >> np.uint64(40)).astype(np.int64) % WORDS
    out[:, FORM:] = np.bincount(key, minlength=n * WORDS).reshape(n, WORDS)
    np.log1p(out, out=out)
    out[:, FORM:] *= WORD_WEIGHT
    return out


class Sparse:
    """Rows of terms with few entries each; products are built in blocks, so that memory stays near the entries' own."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.at = np.concatenate([np.zeros(0, np.int64), *[r[0].astype(np.int64) for r in rows]])
        self.value = np.concatenate([np.zeros(0, np.float32), *[r[1] for r in rows]])
        self.row = np.repeat(np.arange(self.n), [len(r[0]) for r in rows])
        self.by_term = np.argsort(self.at, kind="stable")

    def _sum(self, group: np.ndarray, other: np.ndarray, index: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
        """Sums of value * other[index] by group; groups are in order."""
        out = np.zeros((size, other.shape[1]), np.float32)
        for lo in range(0, len(group), 1 << 15):
            g = group[lo : lo + (1 << 15)]
            new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            out[g[new]] += np.add.reduceat(value[lo : lo + (1 << 15), None] * other[index[lo : lo + (1 << 15)]], new, axis=0)
        return out

    def times(self, other: np.ndarray) -> np.ndarray:
        return self._sum(self.row, other, self.at, self.value, self.n)

    def turned_times(self, other: np.ndarray) -> np.ndarray:
        o = self.by_term
        return self._sum(self.at[o], other, self.row[o], self.value[o], TERMS)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Voters:
    """The projection (scale included), the unit vectors of the labelled sample and its labels."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        """rows: terms and counts of each labelled text."""
        self.labels = labels.astype(np.float64)
        rows = [(at, value / max(float(np.linalg.norm(value)), 1e-9)) for at, value in rows]
        terms = Sparse(rows)
        square = np.bincount(terms.at, terms.value.astype(float) ** 2, TERMS) / max(1, terms.n)
        scale = np.minimum(1 / np.sqrt(square + 1e-6), 40.0).astype(np.float32)
        terms.value = terms.value * scale[terms.at]
        rank = min(RANK, max(1, terms.n))
        q = terms.times(np.random.default_rng(7).standard_normal((TERMS, rank + 16)).astype(np.float32))
        for _ in range(3 if terms.n else 0):
            q, _ = np.linalg.qr(q)
            q = terms.times(terms.turned_times(q))
        if terms.n:
            q, _ = np.linalg.qr(q)
            small = terms.turned_times(q)  # of the sample, seen from q
            values, turn = np.linalg.eigh((small.T @ small).astype(np.float64))
            best = np.argsort(-values)[:rank]
            axes = small @ (turn[:, best] / np.sqrt(np.maximum(values[best], 1e-9))).astype(np.float32)
        else:
            axes = np.zeros((TERMS, 1), np.float32)
        self.axes = (axes * scale[:, None]).astype(np.float32)
        self.vectors = _unit(terms.times(axes))

    def project(self, texts: pa.Array) -> np.ndarray:
        return _unit(_unit(counts(texts)) @ self.axes)

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for lo, hi in textkit.chunks(texts):
            some = texts.slice(lo, hi - lo)
            got = np.full(len(some), 0.5)
            k = min(NEAREST, len(self.labels))
            for at in range(0, len(some) if k else 0, 256):
                near = self.project(some.slice(at, 256)) @ self.vectors.T
                best = np.argpartition(near, len(self.labels) - k, axis=1)[:, len(self.labels) - k :]
                weight = np.maximum(np.take_along_axis(near, best, 1), 1e-3).astype(np.float64) ** POWER
                got[at : at + 256] = (weight * self.labels[best]).sum(1) / weight.sum(1)
            out.append(np.clip(got, 0, 1))
        return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, eligible: Column | None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Voters:
    """From at most `sample` rows of each label; only their sparse counts reach the driver."""
    rows = labels.where("doc_id is not null and label in (0, 1)")
    rows = (rows.where(eligible) if eligible is not None else rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = None
    for label in (0, 1):
        some = rows.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    picked = materialise(picked, "quality-sample").select(F.col("doc_id").alias("of"), "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textkit.chunks(batch.column(1)):
                x = counts(batch.column(1).slice(lo, hi - lo))
                used = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([u.astype(np.uint16).tobytes() for u in used], pa.binary()), pa.array([r[u].tobytes() for r, u in zip(x, used)], pa.binary()), batch.column(2).slice(lo, hi - lo)],
                    ["id", "at", "value", "label"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("of"))
    got = mine.select("id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, f"id {kind}, at binary, value binary, label int")
    got = got.groupBy("id").agg(F.min(F.struct("at", "value", "label")).alias("r")).select("id", "r.*").orderBy("id").toArrow()  # repeated ids count once
    rows = [(np.frombuffer(at, np.uint16), np.frombuffer(value, np.float32)) for at, value in zip(got["at"].to_pylist(), got["value"].to_pylist())]
    return Voters(rows, got["label"].to_numpy())


def score(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows of docs with one more column; a column of that name is replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(voters)
    docs = tables.without(docs, text_col, name)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shipped.value.scores(batch.column(at)))], [*batch.schema.names, name])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_in(doc_id: Column) -> Column:
    return tables.remainder(doc_id, 3) != 1


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    voters = fit(docs, labels, held_in(F.col("doc_id")))
    return score(docs, voters).select("doc_id", (~held_in(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
