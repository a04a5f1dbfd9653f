"""Toxicity by class-conditional Kneser-Ney models of words in context.

Two interpolated models, one of toxic and one of ordinary labelled texts, give each
word a probability after the word before it. Counts are of texts that hold an
expression, so that a word repeated in one text is no evidence. An absolute discount
is taken from every pair's and word's count, and all of its mass is handed on:

    p(w | v) = max(n(v w) - D, 0) / n(v .) + rest(v) * p(w)
    p(w)     = max(n(w) - D, 0) / n(.) + rest * shared(w)

rest is what the discounts left over, so the probabilities of all words sum to 1. What
is rare falls back on shared(w), which is the same for both classes and so says nothing
for either: continuation counts (how many different words precede w in labelled texts
of both classes), discounted in turn towards w's share of the words of all documents.

The logarithms of a passage's likelihoods under the two models, divided by its number of
words, are compared; a text's evidence is that of its most toxic passage of RUN words
(a shorter text is one passage), since a few words make a long text toxic.

Beside passages stand the words alone and their beginnings of STEMS letters, which tell
inflected words that no labelled text holds. Here a class gives an expression the
discounted share of its texts that hold it, and half a discount to every expression; a
text's second evidence is the largest log ratio of these shares, at least 0. Passages of
copied texts outweigh real ones among pairs, which is why words are also asked alone.

A logistic calibration on the two numbers turns them into a score; for it the labelled
texts are read by the models without their own counts, and classes weigh by the square
root of their sizes, midway between as they stand and alike.

Labels are learnt from at most TRAIN toxic and TRAIN ordinary rows of TRAIN_CHARS
characters in all, chosen by hash; shares of words are counted over every document.
With labels of one class only, or none, every score is 0.5. Null and empty texts have no
evidence and get the score of that. Labels, ids, sources and languages are no inputs of
a score; repeated rows score alike. Very long texts are read whole, an empty table gives
no rows, and extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm import tables, textkit
from gaugeline.scratch import materialise
from gaugeline.session import table

TRAIN, TRAIN_CHARS = 8000, 40_000_000
#: Taken from the counts of a class: what three texts or fewer hold is left to the shared counts.
DISCOUNT = 3.0
#: Taken from the shared continuation counts.
SHARED_DISCOUNT = 0.75
RUN = 2
#: Letters of a longer word that are looked at by themselves.
STEMS = (4, 5, 6, 7)
WORD, PAIR, STEM = 0, 1, 2
#: Stands before the first word of a text.
START = np.uint64(0x5DEECE66D)
#: Tells a beginning from a word of the same letters.
_BEGUN = np.uint64(0xA0761D6478BD642F)
_SLOTS = 1 << 20
#: Beginnings that a task holds until it sums them up.
STEMS_HELD = 1 << 21


def _spelled(texts: pa.Array, stems: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, word hashes, each row's first word, hashes of words' beginnings, the word of each) by chunks of rows."""
    for lo, hi in textkit.chunks(texts):
        data, offsets = textkit.buffers(pc.utf8_lower(texts.slice(lo, hi - lo)))
        starts, ends, first = textkit.words(data, offsets, textkit.NOT_ALNUM)
        of, stop = _beginnings(data, starts, ends) if stems else (np.zeros(0, np.int64),) * 2
        h = textkit.word_hashes(data, np.concatenate([starts, starts[of]]), np.concatenate([ends, stop]))
        yield hi - lo, h[: len(starts)], first, h[len(starts) :] ^ _BEGUN, of


def _beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that have more letters than each of STEMS, and the byte where that beginning ends."""
    letters = np.flatnonzero((data & 0xC0) != 0x80)
    rank, found = np.searchsorted(letters, starts), []
    for k in STEMS:
        of = np.flatnonzero(rank + k < len(letters))
        stop = letters[rank[of] + k]
        longer = stop < ends[of]
        found.append((of[longer], stop[longer]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, word hashes, each row's first word) by chunks of rows."""
    for n, words, first, _, _ in _spelled(texts, stems=False):
        yield n, words, first


def _pairs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word, and a hash of both."""
    before = np.concatenate([[START], words[:-1]]) if len(words) else words
    before[first[:-1][first[:-1] < len(words)]] = START
    return before, textkit.combine([before, words]) if len(words) else words


def _once(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each key first stands in its row."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return order[new]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to (kind, key, before, word, toxic, ordinary): texts of each class that hold an expression."""
    for batch in batches:
        labels, at = batch.column(1).to_numpy(zero_copy_only=False), 0
        begun, held = [], 0
        for n, words, first, stems, of in _spelled(batch.column(0)):
            row = np.repeat(np.arange(n), np.diff(first))
            before, pair = _pairs(words, first)
            for kind, key in ((WORD, words), (PAIR, pair)):
                some = _once(row, key)
                toxic = labels[at : at + n][row[some]] == 1
                yield _counters(kind, key[some], before[some], words[some], toxic, ~toxic)
            some = _once(row[of], stems)
            begun.append((stems[some], labels[at : at + n][row[of[some]]] == 1))
            held += len(some)
            if held >= STEMS_HELD:
                yield _summed(begun)
                begun, held = [], 0
            at += n
        if begun:
            yield _summed(begun)


def _counters(kind: int, key: np.ndarray, before: np.ndarray, word: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(key), kind, np.int8), *[textkit.signed(x) for x in (key, before, word)], toxic.astype(np.int64), ordinary.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "before", "word", "toxic", "ordinary"])


def _summed(begun: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row for each beginning of some texts."""
    stems, toxic = (np.concatenate(x) for x in zip(*begun))
    key, at = np.unique(stems, return_inverse=True)
    of_toxic, of_both = np.bincount(at, toxic, len(key)), np.bincount(at, minlength=len(key))
    none = np.zeros(len(key), np.uint64)
    return _counters(STEM, key, none, none, of_toxic, of_both - of_toxic)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands among sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """Sorted expressions with counts by class (ordinary first), and the shared probabilities of the words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, shared: np.ndarray, histories: np.ndarray, held: np.ndarray, kept: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, totals: np.ndarray, discount: float = DISCOUNT):
        """held: pairs' counts by the word before (n(v .)); kept: the same after the discount. Rows are classes, columns follow the keys before."""
        self.words, self.counts, self.shared = words, counts, shared
        self.histories, self.held, self.kept = histories, held, kept
        self.pairs, self.pair_counts = pairs, pair_counts
        self.discount, self.totals = discount, np.maximum(totals.astype(float), 1.0)[:, None]
        self.rest = 1.0 - np.maximum(counts - discount, 0.0).sum(1, keepdims=True) / self.totals

    def log_likelihoods(self, words: np.ndarray, first: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """log p(word | word before) under both models, a row each; a word of no labelled text counts as one of shared probability 1.

        label: of each word's text, if the text is among those counted; it then counts as left out.
        """
        if not len(words):
            return np.zeros((2, 0))
        own = np.zeros((2, len(words))) if label is None else np.stack([label == 0, label == 1]).astype(float)
        at, known = _find(self.words, words)
        counts, shared = (self.counts[:, at] * known, np.where(known, self.shared[at], 1.0)) if len(self.words) else (np.zeros((2, len(words))), np.ones(len(words)))
        p = np.maximum(counts - own - self.discount, 0.0) / self.totals + self.rest * shared
        before, pair = _pairs(words, first)
        at, known = _find(self.histories, before)
        if len(self.histories):
            held = self.held[:, at]
            seen = np.maximum(held - own, 0.0) * known
            at, paired = _find(self.pairs, pair)
            n = self.pair_counts[:, at] * paired if len(self.pairs) else np.zeros((2, len(words)))
            rest = 1.0 - self.kept[:, _find(self.histories, before)[0]] / np.maximum(held, 1.0)
            p = np.where(seen > 0, np.maximum(n - own * paired - self.discount, 0.0) / np.maximum(seen, 1.0) + rest * p, p)
        return np.log(np.maximum(p, 1e-300))

    def evidence(self, texts: pa.Array, labels: np.ndarray | None = None) -> np.ndarray:
        """Of each text, the difference of the length-normalised log-likelihoods, toxic less ordinary, of its most toxic passage."""
        out, done = [np.zeros(0)], 0
        for n, words, first in _tokens(texts):
            out.append(self.passages(n, words, first, None if labels is None else labels[done : done + n]))
            done += n
        return np.concatenate(out)

    def passages(self, n: int, words: np.ndarray, first: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """The same of n rows of words; label: of each row."""
        count = np.diff(first)
        row = np.repeat(np.arange(n), count)
        ordinary, toxic = self.log_likelihoods(words, first, None if label is None else label[row])
        found, some = np.zeros(n), np.flatnonzero(count)
        if len(some):
            total = np.concatenate([[0.0], np.cumsum(toxic - ordinary)])
            place = np.arange(len(words))
            stop = np.minimum(place + RUN, first[1:][row])
            whole = stop - place >= np.minimum(RUN, count[row])  # a passage ends with its text at the latest
            passage = np.where(whole, (total[stop] - total[:-1]) / np.minimum(RUN, count[row]), -np.inf)
            found[some] = np.maximum.reduceat(passage, first[:-1][some])
        return found


class Expressions:
    """Sorted words and beginnings of words that toxic texts favour, and how many texts of each class (ordinary first) hold them."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, texts: np.ndarray, discount: float = DISCOUNT):
        self.discount, self.texts = discount, np.maximum(texts.astype(float), 1.0)[:, None]
        less = np.maximum(counts - np.array([[1.0], [0.0]]), 0.0)  # an ordinary text's own count may be left out
        order = np.argsort(keys)
        order = order[(self.ratio(less) > 0)[order]]
        self.keys, self.counts = keys[order], counts[:, order]
        self.slots = np.zeros(_SLOTS, bool)
        self.slots[self.keys % np.uint64(_SLOTS)] = True

    def ratio(self, counts: np.ndarray) -> np.ndarray:
        share = (np.maximum(counts - self.discount, 0.0) + self.discount / 2) / self.texts
        return np.log(share[1]) - np.log(share[0])

    def evidence(self, n: int, row: np.ndarray, keys: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """The largest log ratio of each of n rows; label: of each row, if these are among the texts counted (they then count as left out)."""
        best = np.zeros(n)
        some = np.flatnonzero(self.slots[keys % np.uint64(_SLOTS)])
        at, known = _find(self.keys, keys[some])
        row, at = row[some[known]], at[known]
        if len(at):
            own = 0.0 if label is None else np.stack([label[row] == 0, label[row] == 1])
            np.maximum.at(best, row, self.ratio(np.maximum(self.counts[:, at] - own, 0.0)))
        return best


def features(texts: pa.Array, model: Model, expressions: Expressions, labels: np.ndarray | None = None) -> np.ndarray:
    """Of each text, the evidence of its passages and that of its words and their beginnings."""
    out, done = [np.zeros((0, 2))], 0
    for n, words, first, stems, of in _spelled(texts):
        label = None if labels is None else labels[done : done + n]
        row = np.repeat(np.arange(n), np.diff(first))
        alone = expressions.evidence(n, np.concatenate([row, row[of]]), np.concatenate([words, stems]), label)
        out.append(np.stack([model.passages(n, words, first, label), alone], 1))
        done += n
    return np.concatenate(out)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN, chars: int = TRAIN_CHARS) -> DataFrame:
    """(text, label): at most `most` labelled rows of each class, chosen by hash among those not held out, as far as `chars` characters go."""
    rows = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = rows.where(tables.remainder(F.col("doc_id"), 5) != 0)
    toxic, ordinary = (rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (1, 0))
    known = materialise(toxic.unionByName(ordinary), "toxicity-sample").select(F.col("doc_id").alias("of"), F.col("label").cast("int").alias("label"))
    mine = docs.select(F.col(id_col).alias("id"), tables.text_of(text_col).alias("text")).join(F.broadcast(known), F.col("id") == F.col("of"))
    mine = mine.groupBy("id", "label").agg(F.min("text").alias("text"))  # of rows that repeat an id one counts
    up_to = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    return materialise(mine.withColumn("up_to", up_to).where(F.col("up_to") <= chars).select("text", "label"), "toxicity-texts")


def _classes(rows: pa.Table, *names: str) -> list[np.ndarray]:
    """Sorted keys, and pairs of columns as rows in that order."""
    key = np.ascontiguousarray(rows["key"].to_numpy()).view(np.uint64)
    order = np.argsort(key)
    return [key[order], *[np.stack([rows[f"{c}{n}"].to_numpy().astype(np.float64)[order] for c in ("ordinary", "toxic")]) for n in names]]


def shares(docs: DataFrame, words: np.ndarray, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How often each of some words stands in all documents, and how many words these have."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        counts = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for _, some, _ in _tokens(batch.column(0)):
                at, found = _find(known, some)
                counts += np.bincount(np.where(found, at, len(known)), minlength=len(counts))
        used = np.flatnonzero(counts)
        for at in range(0, len(used), 1 << 16):
            part = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], ["at", "n"])

    got = docs.select(F.col(text_col)).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    shipped.destroy()
    counts = np.zeros(len(words) + 1, np.int64)
    counts[got["at"].to_numpy()] = got["n"].to_numpy()
    return counts[:-1], int(counts.sum())


def shared_probabilities(continuations: np.ndarray, counts: np.ndarray, total: int) -> np.ndarray:
    """Discounted continuation counts, backed off to shares of all documents' words; with the words beyond these they sum to 1."""
    kinds = max(1.0, float(continuations.sum()))
    left = np.minimum(continuations, SHARED_DISCOUNT)
    return (continuations - left) / kinds + left.sum() / kinds * counts / max(1, total)


def count(texts: DataFrame) -> DataFrame:
    """Expressions of labelled texts (text, label) with the number of texts of each class that hold them."""
    counters = texts.select("text", "label").mapInArrow(_count, "kind byte, key long, before long, word long, toxic long, ordinary long")
    sums = [F.sum(c).alias(c) for c in ("toxic", "ordinary")]
    return materialise(counters.groupBy("kind", "key").agg(F.first("before").alias("before"), F.first("word").alias("word"), *sums), "toxicity-counts")


def express(texts: DataFrame, counted: DataFrame) -> Expressions:
    """Words and beginnings that more toxic texts hold than the discount takes away."""
    found = counted.where((F.col("kind") != PAIR) & (F.col("toxic") > DISCOUNT)).select("key", "toxic", "ordinary").toArrow()
    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    return Expressions(*_classes(found, ""), np.array([sizes.get(0, 0), sizes.get(1, 0)]))


def fit(docs: DataFrame, texts: DataFrame, text_col: str = "text", counted: DataFrame | None = None) -> Model:
    """Counts of labelled texts (text, label) and shares over all documents; what reaches the driver is bounded by the sample's words."""
    counted = count(texts) if counted is None else counted
    sums = [F.sum(c).alias(c) for c in ("toxic", "ordinary")]
    pairs = counted.where(F.col("kind") == PAIR)
    of_words = counted.where(F.col("kind") == WORD).join(pairs.groupBy("word").agg(F.count("*").alias("continuations")), "word")
    of_words = of_words.select("key", "toxic", "ordinary", "continuations").toArrow()
    left = [F.sum(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))).alias(f"{c}_kept") for c in ("toxic", "ordinary")]
    of_histories = pairs.groupBy(F.col("before").alias("key")).agg(*sums, *left).toArrow()
    of_pairs = pairs.where(F.greatest("toxic", "ordinary") > DISCOUNT).select("key", "toxic", "ordinary").toArrow()
    words, counts = _classes(of_words, "")
    continuations = of_words["continuations"].to_numpy().astype(float)[np.argsort(np.ascontiguousarray(of_words["key"].to_numpy()).view(np.uint64))]
    stand, total = shares(docs, words, text_col)
    shared = shared_probabilities(continuations, stand, total)
    return Model(words, counts, shared, *_classes(of_histories, "", "_kept"), *_classes(of_pairs, ""), counts.sum(1))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression with a bias, by Newton's steps."""
    if not len(y) or len(set(y)) < 2:
        return np.zeros(x.shape[1] + 1)
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    w, keep = np.zeros(a.shape[1]), np.diag([1e-6] + [decay] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + keep, a.T @ (weight * (p - y)) + keep @ w)
    return w


def left_out(texts: DataFrame, model: Model, expressions: Expressions) -> tuple[np.ndarray, np.ndarray]:
    """Evidence and labels of the sampled texts, each read without its own counts; bounded by the sample."""
    shipped = texts.sparkSession.sparkContext.broadcast((model, expressions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1)
            found = features(batch.column(0), *shipped.value, label.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([label, *map(pa.array, found.T.copy())], ["label", "evidence", "alone"])

    got = texts.select("text", "label").mapInArrow(run, "label int, evidence double, alone double").toArrow()
    shipped.destroy()
    return np.stack([got[c].to_numpy() for c in ("evidence", "alone")], 1), got["label"].to_numpy().astype(float)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, evidence, alone, score) of each row; labels: (doc_id, label)."""
    texts = sample(docs, labels, id_col, text_col)
    counted = count(texts)
    model, expressions = fit(docs, texts, text_col, counted), express(texts, counted)
    x, y = left_out(texts, model, expressions)
    order = np.lexsort((*x.T, y))  # sums in one order, whatever order the rows came in
    x, y = x[order], y[order]
    weight = np.array([(y == v).sum() ** -0.5 for v in y])
    w = calibrate(x, y, weight * (len(y) / weight.sum()) if len(y) else weight)
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast((model, expressions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(batch.column(1), *shipped.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T.copy())], ["id", "evidence", "alone"])

    found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, evidence double, alone double")
    logit = F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("evidence") + F.lit(float(w[2])) * F.col("alone")
    return found.select("id", "evidence", "alone", (1 / (1 + F.exp(-logit))).alias("score"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    found = score(tables.documents(spark, sf_dir), labels)
    return found.select(
        F.col("id").alias("doc_id"), (tables.remainder(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
