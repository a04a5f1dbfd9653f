"""Spelling variants: words one edit apart, grouped under the most frequent spelling.

The words form a trie. At a node, the child with most words below is heavy, the others and the
end of a word are light; a word is light at log2(words) + 1 of its nodes at most. Only light
words move: their rest, with the node's character skipped or replaced, is merged into what
else is below the node, small into large. Of two words one edit apart, which part at a node:

* replaced: one is light. The other is heavy and is the light one with the heavy character in
  place of its own; or it is light too, and both have one rest below the node.
* skipped: the longer one is light and is the shorter one when its character is skipped; or
  it is heavy, and the shorter one is light and is the longer one with the heavy character before its rest.

Where the merged rest ends at a word, both are a pair. A node is a prefix, its size a count by
prefix, and merging is an equality join: words x log2(words) rows, where deleting any
character would need words x length. Prefixes, rests and words stand as sums of 64 bits that
shift and add, so a row is short however long the word; equal sums are verified on the words
themselves. A node's light words with one rest differ in one character, so no group is larger
than the alphabet.

Counting words reads each text once; a task sums what it meets before the shuffle, and empties
its sums when they are HELD many.

Odd rows: a null or empty text has no words; a null id counts as an empty one before the
colon of the hash; repeated rows count again. Ties go to the word smallest in code-point
order. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import tables, textkit
from gaugeline.scratch import discard, materialise

#: A word is a maximal run of these.
LETTERS = "[A-Za-zÀ-ÿ]+"
SHORTEST, LEAST_TIMES = 5, 3
#: A form is at least so many times as frequent.
TIMES = 2
#: Every so many-th hash loses a character in the query's texts.
SLIPS = 97
#: Base of the sums that stand for words and their parts, and its inverse modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Different words that a task holds before it gives their sums out.
HELD = 1 << 17
#: Bytes of words that are worked on at a time.
TOGETHER = 1 << 17


def words_of(text: str) -> list[str]:
    """The words; only A-Z are lower-cased."""
    return re.findall(LETTERS, text.encode().lower().decode())


def slipped(words: Counter, doc_id: str, every: int) -> Counter:
    """Counts of the words of a text, of which those whose hash `every` divides lack one character."""
    at = zlib.crc32(f"{doc_id}:".encode())
    out = Counter()
    for word, n in words.items():
        h = zlib.crc32(word.encode(), at)
        if h % every == 0:
            h %= len(word)
            word = word[:h] + word[h + 1 :]
        out[word] += n
    return out


def word_counts(docs: DataFrame, text_col: str = "text", id_col: str | None = None, slips: int | None = None, shortest: int = SHORTEST, least: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of words that are long and frequent enough; with slips, words of a row lose a character where their hash says so."""
    rows = docs.select((F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")).alias("id"), F.col(text_col).alias("text"))

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                here = Counter(words_of(text.as_py() or ""))
                for word, n in (slipped(here, doc_id.as_py() or "", slips) if slips else here).items():
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD:
                    yield out(held)
                    held = Counter()
        yield out(held)

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def powers(n: int) -> np.ndarray:
    steps = np.full(n + 1, BASE)
    steps[0] = 1
    return np.cumprod(steps)


class _Batch:
    """Words of a column as characters behind each other: code points and one, so that 0 is the end of a word."""

    def __init__(self, words: pa.Array):
        texts = words.to_pylist()
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.first = np.cumsum(self.size) - self.size
        place = np.arange(len(self.x)) - np.repeat(self.first, self.size)
        steps = self.x * powers(int(self.size.max(initial=0)))[place]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(steps, dtype=np.uint64)])

    def keys(self) -> np.ndarray:
        return self.sums[self.first + self.size] - self.sums[self.first]


def _cut(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of words of bounded length together; a longer word stands alone."""
    for lo, hi in textkit.chunks(batch.column(column), TOGETHER):
        yield batch.slice(lo, hi - lo)


def keyed(words: DataFrame) -> DataFrame:
    """words with key, the sum of their characters times powers of BASE by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _cut(whole, "word"):
                keys = _Batch(batch.column("word")).keys()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


_PLACE = "key long, i int, head long, c int, next int, rest long"


def places(words: DataFrame) -> DataFrame:
    """(key, i, head, c, next, rest): a row for each place of a word and one for its end, where c is 0; head and rest are the sums before and behind the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _cut(whole, "word"):
                b = _Batch(batch.column("word"))
                rows = b.size + 1
                word = np.repeat(np.arange(len(rows)), rows)
                i = np.arange(len(word)) - np.repeat(np.cumsum(rows) - rows, rows)
                at, left = b.first[word] + i, b.size[word] - i
                x = np.concatenate([b.x, np.zeros(2, np.uint64)])
                c, following = np.where(left > 0, x[at], 0), np.where(left > 1, x[at + 1], 0)
                head = b.sums[at] - b.sums[b.first[word]]
                rest = np.where(left > 0, b.sums[b.first + b.size][word] - b.sums[np.minimum(at + 1, len(b.x))], np.uint64(0))
                columns = [b.keys()[word].view(np.int64), i.astype(np.int32), head.view(np.int64), c.astype(np.int32), following.astype(np.int32), rest.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["key", "i", "head", "c", "next", "rest"])

    return words.select("word").mapInArrow(run, _PLACE)


def light_rows(words: DataFrame) -> DataFrame:
    """places() at nodes of the trie where the word is light, with heavy, the node's heavy character or null."""
    at = places(words)
    children = at.groupBy("i", "head", "c").agg(F.count("*").alias("below"))
    inner = F.when(F.col("c") > 0, F.struct("below", "c"))
    nodes = children.groupBy("i", "head").agg(F.sum("below").alias("below"), F.max(inner)["c"].alias("heavy")).where("below > 1")
    nodes = materialise(nodes, "spelling-nodes")
    light = materialise(tables.join_hot(at, nodes, ["i", "head"], "below", ["heavy"]).where("heavy is null or c <> heavy"), "spelling-light")
    discard(nodes)
    return light


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, i, head, c, next, rest, heavy) of light rows to (key, other): where the rest of the word ends with the character replaced or skipped, or the heavy one before it."""
    power = powers(64)
    for batch in batches:
        key, i, head, c, following, rest = (batch.column(k).to_numpy() for k in range(6))
        heavy = batch.column(6).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        if len(i) and i.max() >= len(power):
            power = powers(int(i.max()))
        p, head, rest, at = power[i], head.view(np.uint64), rest.view(np.uint64), c.astype(np.uint64)
        ways = [
            ((c > 0) & (heavy > 0), head + heavy * p + rest),
            ((c > 0) & (following != c), head + rest * BASE_INVERSE),
            (heavy > 0, head + heavy * p + (at * p + rest) * BASE),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[ok] for ok, _ in ways])), pa.array(np.concatenate([to[ok] for ok, to in ways]).view(np.int64))], ["key", "other"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): each pair of words one inserted, deleted or replaced character apart, once."""
    words = materialise(keyed(words), "spelling-keyed")
    light = light_rows(words)
    reached = light.mapInArrow(merged, "key long, other long")
    reached = reached.join(words.select(F.col("key").alias("other")).distinct(), "other", "left_semi")
    both = light.where("c > 0").select("i", "head", "rest", "key")
    twins = both.join(both.withColumnRenamed("key", "other"), ["i", "head", "rest"]).where("key < other").select("key", "other")
    pairs = reached.select("key", "other").unionByName(twins).distinct()
    a, b = (words.select(F.col("key").alias(k), F.col("word").alias(w)) for k, w in (("key", "a"), ("other", "b")))
    out = materialise(pairs.join(a, "key").join(b, "other").where(F.levenshtein("a", "b", 1) == 1).select("a", "b"), "spelling-pairs")
    discard(words, light)
    return out


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table (word, n), each word once: its near words counted, the form that is TIMES as frequent, and the last of its forms."""
    words = materialise(words.select("word", "n"), "spelling-words")
    pairs = near_words(words)
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(words.select(F.col("word").alias("b"), "n"), "b")
    best = ends.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "b")).alias("best"))
    best = best.select("word", "n_near", F.col("best.b").alias("form"), (-F.col("best.n")).alias("form_n"))
    fits = F.col("form_n") >= TIMES * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    out = materialise(out, "spelling-forms")
    # each round doubles the forms that are passed over; a form is at least TIMES as frequent, so 64 are enough for any count
    hops = materialise(out.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(hops.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        more = not moved.where("moved").isEmpty()
        discard(hops)
        hops = moved.select("word", "root")
        hops._scratch_path = moved._scratch_path
        if not more:
            break
    rooted = materialise(out.join(hops, "word", "left").withColumn("root", F.coalesce("root", "word")), "spelling-out")
    discard(words, pairs, out, hops)
    return rooted


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all documents."""
    words = word_counts(tables.documents(spark, sf_dir), id_col="doc_id", slips=SLIPS)
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
