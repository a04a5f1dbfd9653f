"""Near-duplicate documents by Order MinHash and banded alignment.

Words are lower-cased runs of letters and digits. Each shingle carries its
occurrence number within the text, so a repeated one counts each time. Each of a
family's orders of the labelled shingles picks the LEAST smallest ones and keeps
them in text order: two texts share such a key more likely the nearer they are by
edits, not only by content. Shingles are of five words; texts too short for these
to outlive scattered edits take shorter ones (FAMILIES). The families' lengths
overlap, so that two texts whose lengths can match have one in common.

Each text is paired with the best leader of its keys, the text that meets most others
under all its keys: of a text and its edited copies nearly always the text. A pair
counts if the banded alignment of its words finds an edit similarity of at least
SIMILARITY (1 - edits / longer length). Classes are the connected components of these
links. Then come rounds for keys whose texts are not of one class, until no pair under
a key is left untried: a text is compared with all members of a class of BIG texts that
it shares a key with, in blocks, and texts of smaller classes with each other, in tiles.
Blocks and tiles are of bounded size and read a bitmap of each text, the parities of its
hashed words, whose difference edits bound; only pairs that this leaves possible come
out. The first of two rounds takes one block of each class, a sample by hash, and of
it the nearest few, so that the second finds few texts that still belong to the class.

Texts with equal words are one node from the start: copies, however many, are
never paired. Texts without words are equal to each other only if both have none.
Null counts as empty; very long texts are read whole; an empty table gives no rows;
extra columns, whatever their names, are not looked at. Of each class the smallest id
stays (a null id only if alone); of repeated rows with one id, one stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gaugeline.llm import tables, textkit
from gaugeline.operators.graph import connected_components
from gaugeline.scratch import discard, materialise

LEAST = 2
#: (words from, words up to, words of a shingle, orders).
FAMILIES = ((1, 12, 1, 32), (10, 63, 2, 32), (51, 1 << 40, 5, 112))
SIMILARITY = 0.8
#: Nodes from which a class is compared as a whole.
BIG = 64
#: Of a text and the first block of a class, the pairs that the first round of these tries.
NEAREST = 4
#: Nodes of a key's block, and of a class's and its queries' blocks: two blocks meet in a task at once, on average.
TILE, BLOCK = 4096, 512
#: Bits of a bitmap for each word of the text, and bounds of its width in longs; widths are powers of two.
DENSITY = 8
NARROW, WIDE = 4, 2048
#: Cells up to which alignment tabulates whole diagonals; beyond, it goes row by row.
DENSE = 4_000_000
_SEEDS = textkit.mix(np.arange(1, max(f[3] for f in FAMILIES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FLIP = (_SEEDS & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, word hashes, each row's first word)."""
    for lo, hi in textkit.chunks(texts):
        data, offsets = textkit.buffers(pc.utf8_lower(texts.slice(lo, hi - lo)))
        starts, ends, first = textkit.words(data, offsets, textkit.NOT_ALNUM)
        yield lo, hi, textkit.word_hashes(data, starts, ends), first


def nodes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's word sequence, as two hashes."""
    place = (np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
    out = []
    for salt in (0x1234567, 0x89ABCDEF):
        total = np.concatenate([[np.uint64(0)], np.cumsum(textkit.combine([words, place + np.uint64(salt)]), dtype=np.uint64)])
        out.append(textkit.mix((total[first[1:]] - total[first[:-1]]) ^ textkit.mix(np.diff(first).astype(np.uint64) + np.uint64(salt))))
    return out[0], out[1]


def _labelled(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of one text's shingles of `size` words with their occurrence numbers, in text order."""
    n = max(1, len(words) - size + 1)
    shingles = textkit.combine([words[i : i + n] for i in range(min(size, len(words)))])
    ranked = np.sort(shingles)
    if not (ranked[1:] == ranked[:-1]).any():
        return textkit.mix(shingles)
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    nth = np.empty(n, np.uint64)
    nth[order] = (np.arange(n) - begin).astype(np.uint64)
    return textkit.mix(shingles + nth * np.uint64(0x9E3779B97F4A7C15))


def _picked(shingles: np.ndarray, orders: int) -> np.ndarray:
    """Places of the LEAST smallest shingles in each order, in text order; a row for each order."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = []
    for at in range(0, orders, 16):
        h = (short[None, :] ^ _FLIP[at : at + 16, None]) * _FACTOR[at : at + 16, None]
        h ^= h >> np.uint32(15)
        which, place = np.arange(len(h)), []
        for _ in range(min(LEAST, len(shingles))):
            place.append(h.argmin(1))
            h[which, place[-1]] = np.uint32(0xFFFFFFFF)
        out.append(np.sort(np.stack(place, 1), axis=1))
    return np.concatenate(out)


def sketch(words: np.ndarray) -> np.ndarray:
    """The keys of one text, of each family that its length calls for."""
    keys = []
    for least, most, size, orders in FAMILIES:
        if least <= len(words) <= most:
            shingles = _labelled(words, size)
            place = _picked(shingles, orders)
            order = np.arange(orders, dtype=np.uint64) + np.uint64(size << 32)
            keys.append(textkit.combine([order, *[shingles[place[:, i]] for i in range(place.shape[1])]]))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def edits(a: np.ndarray, b: np.ndarray, most: int, least: int = 0) -> int:
    """Edit distance of two sequences if at most `most`, else most + 1; the band doubles until it holds the answer, which is no less than `least`."""
    if len(a) > len(b):
        a, b = b, a
    same = a == b[: len(a)]
    head = len(a) if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    if len(a):
        same = a[::-1] == b[::-1][: len(a)]
        tail = len(a) if same.all() else int(np.argmin(same))
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or len(b) - len(a) > most:
        return min(len(b), most + 1)
    width = max(8, len(b) - len(a), least + least // 8)
    while True:
        width = min(width, most)
        found = _reaching(a, b, width) if (2 * width + 1) * len(a) <= DENSE else _banded(a, b, width)
        if found <= width or width >= most:
            return min(found, most + 1)
        width *= 2


def _reaching(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """Edit distance within k of the diagonal, by how far each number of edits reaches on each diagonal; k + 1 if above."""
    n, m = len(a), len(b)
    padded = np.full(n + 2 * k + max(m - n, 0), -1, np.int64)
    padded[k : k + m] = b
    windows = np.lib.stride_tricks.sliding_window_view(padded, n)[: 2 * k + 1]
    stops = np.full((2 * k + 1, n + 1), n, np.int32)  # the next place from which a diagonal cannot go on for free
    stops[:, :n] = np.where(windows == a.astype(np.int64), n, np.arange(n))
    stops = np.minimum.accumulate(stops[:, ::-1], axis=1)[:, ::-1]
    diagonal = np.arange(-k, k + 1)
    most = np.minimum(n, m - diagonal)
    least = np.maximum(0, -diagonal)
    place = np.arange(2 * k + 1)
    far = np.full(2 * k + 3, -(1 << 30), np.int64)
    far[k + 1] = stops[k, 0]
    goal = m - n + k + 1
    for edit in range(k + 1):
        if far[goal] >= n:
            return edit
        step = np.minimum(np.maximum(np.maximum(far[1:-1], far[2:]) + 1, far[:-2]), most)
        ok = step >= least
        far[1:-1] = np.where(ok, stops[place, np.where(ok, step, 0)], -(1 << 30))
    return k + 1


def _banded(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """Edit distance within k of the diagonal; a value above k says only that it is above k."""
    n, m = len(a), len(b)
    size, far = 2 * k + 1, n + m + 1
    padded = np.concatenate([np.zeros(k, b.dtype), b, np.zeros(k + 1, b.dtype)])
    column = np.arange(size) - k  # of row 0
    row = np.where((column >= 0) & (column <= m), column, far)
    step = np.arange(size)
    for i in range(1, n + 1):
        column = column + 1
        diagonal = row + (padded[i - 1 : i - 1 + size] != a[i - 1])
        above = np.concatenate([row[1:], [far]]) + 1
        row = np.minimum(diagonal, above)
        row[(column < 0) | (column > m)] = far
        if i <= k:
            row[k - i] = i  # column 0
        row = np.minimum.accumulate(row - step) + step
        if row.min() > k:
            return k + 1
        row[(column < 0) | (column > m)] = far
    return int(row[m - n + k])


def near(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the edit similarity reaches the bound; what words they share bounds it first."""
    longer = max(len(a), len(b))
    most = math.floor((1 - similarity) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    least = int(longer - np.minimum(ca[ia], cb[ib]).sum())
    return least <= most and edits(a, b, most, least) <= most


def width(n: int) -> int:
    """Longs in the bitmap of a text of n words."""
    return min(WIDE, max(NARROW, 1 << max(0, math.ceil(math.log2(max(1, n * DENSITY / 64))))))


def parity(words: np.ndarray) -> np.ndarray:
    """Bits that tell which hashed words, numbered by occurrence, stand an odd number of times."""
    longs = width(len(words))
    if not len(words):
        return np.zeros(longs, np.int64)
    place = (_labelled(words, 1) & np.uint64(64 * longs - 1)).astype(np.int64)  # the halves of a wide bitmap fold onto a narrow one
    odd = np.bincount(place, minlength=64 * longs) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, a, b, n, keys, bits): each row's number, its node (a, b), number of words, keys and parities."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36  # the table is written, so a number stays with its row
        for batch in batches:
            for lo, hi, words, first in _words(batch.column(1)):
                a, b = nodes(words, first)
                texts = [words[first[i] : first[i + 1]] for i in range(hi - lo)]
                keys, bits = [textkit.signed(sketch(w)) for w in texts], [parity(w) for w in texts]
                numbers = pa.array(np.arange(row, row + hi - lo))
                row += hi - lo
                columns = [batch.column(0).slice(lo, hi - lo), numbers, *[pa.array(textkit.signed(x)) for x in (a, b)], pa.array(np.diff(first).astype(np.int32)), *[pa.array(x, pa.list_(pa.int64())) for x in (keys, bits)]]
                yield pa.RecordBatch.from_arrays(columns, ["id", "row", "a", "b", "n", "keys", "bits"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, row long, a long, b long, n int, keys array<long>, bits array<long>")


def _fits(x: str, y: str) -> Column:
    """Whether the lengths of two rows can match."""
    return F.least(f"{x}.n", f"{y}.n") >= F.lit(SIMILARITY) * F.greatest(f"{x}.n", f"{y}.n") - 1e-9


def shared(lone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, node, n, score) of keys with several nodes, and (node, n, score, bits) of these nodes; score: how many nodes meet this one, counted under each of its keys."""
    keyed = lone.select("node", F.explode("keys").alias("key"))
    many = keyed.groupBy("key").agg(F.count("*").alias("nodes")).where("nodes > 1")
    rows = materialise(keyed.join(many, "key"), "near-keys")
    score = rows.groupBy("node").agg(F.sum("nodes").alias("score"))
    about = materialise(lone.select("node", "n", "bits").join(score, "node").select("node", "n", "score", "bits"), "near-about")
    out = materialise(rows.select("key", "node").join(about.select("node", "n", "score"), "node"), "near-shared")
    discard(rows)
    return out, about


def _folded(bits: Column) -> Column:
    """A bitmap at half its width: the parities of its halves together."""
    half = F.floor(F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda p, q: p.bitwiseXOR(q))


def possible(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """The pairs whose parities can match: an insertion or deletion changes one bit at most, a substitution two."""
    for s in "xy":
        pairs = pairs.join(about.select(F.col("node").alias(s), F.struct("n", "bits").alias(f"of_{s}")), s)
    p, q = F.col("of_x.bits"), F.col("of_y.bits")
    left, right = F.when(F.size(p) > F.size(q), _folded(p)).otherwise(p), F.when(F.size(q) > F.size(p), _folded(q)).otherwise(q)
    apart = F.aggregate(F.zip_with(left, right, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    most = F.floor(F.lit(1 - SIMILARITY) * F.greatest("of_x.n", "of_y.n") + 1e-9)
    return pairs.where(apart <= 2 * most - F.abs(F.col("of_x.n") - F.col("of_y.n"))).drop("of_x", "of_y")


def _at_widths(rows: DataFrame) -> DataFrame:
    """rows with width, each at the width of its bitmap and, if short enough to match a text of half of it, folded to that.

    Lengths that can match are of one width or of neighbouring ones, so texts that can match have one in common.
    """
    wide = F.size("bits")
    own = F.struct(wide.alias("width"), F.col("bits"))
    # the longest text of half the width has wide / 2 * 64 / DENSITY words
    near = (wide > NARROW) & (F.col("n") * F.lit(SIMILARITY) <= wide * F.lit(32 / DENSITY))
    both = F.when(near, F.array(own, F.struct((wide / 2).cast("int").alias("width"), _folded(F.col("bits")).alias("bits")))).otherwise(F.array(own))
    return rows.withColumn("w", F.explode(both)).withColumns({"width": F.col("w.width"), "bits": F.col("w.bits")}).drop("w")


def candidates(rows: DataFrame, about: DataFrame) -> DataFrame:
    """(x, y) pairs of nodes: each node with the best of its keys' leaders whose length and parities can match."""
    row = F.struct("score", "node", "n")
    led = rows.groupBy("key").agg(F.max(row).alias("x"))
    pairs = rows.select("key", row.alias("y")).join(led, "key")
    pairs = pairs.where(F.col("x.node") != F.col("y.node")).where(_fits("x", "y"))
    pairs = pairs.select(F.col("x.node").alias("x"), F.col("x.score").alias("score"), F.col("y.node").alias("y")).distinct()
    best = possible(pairs, about).groupBy("y").agg(F.max(F.struct("score", "x")).alias("best"))
    return best.select(F.col("best.x").alias("x"), "y")


def still_open(rows: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of keys whose nodes are of several components, with component and members, its size."""
    sizes = components.groupBy("component").agg(F.count("*").alias("members"))
    known = components.join(sizes, "component")
    now = rows.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("members", F.coalesce("members", F.lit(1)))
    ends = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return materialise(now.join(ends.select("key"), "key"), "near-open")


def _near_bits(n: np.ndarray, m: np.ndarray, bits: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of lengths n and these bits can match those of lengths m and other bits, and the distances of all."""
    most = np.floor((1 - SIMILARITY) * np.maximum(n, m) + 1e-9).astype(np.int64)
    gap = np.abs(n - m)
    apart = np.bitwise_count(bits ^ other).sum(1, dtype=np.int64)
    return (gap <= most) & (apart <= 2 * most - gap), apart


def _bits_of(rows: pa.Table, longs: int) -> np.ndarray:
    return np.ascontiguousarray(rows["bits"].combine_chunks().flatten().to_numpy().reshape(-1, longs)).view(np.uint64)


def _pair_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """(score, node) of both ends to (x, y): the greater end as x."""
    ends = [max((s, a), (t, b))[1] for s, a, t, b in rows], [min((s, a), (t, b))[1] for s, a, t, b in rows]
    return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["x", "y"])


def class_pairs(nearest: int | None):
    """(component, block, width, query, node, n, score, bits), sorted so that members stand before queries, to possible pairs of a query and a member; of each query the nearest few, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []  # the members of the block at hand: never more than a block
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            component, block, longs, query, node, n, score = (rows[c].to_numpy() for c in ("component", "block", "width", "query", "node", "n", "score"))
            out = []
            new = np.zeros(len(node), bool)
            new[:1] = True
            for x in (component, block, longs, query):
                new[1:] |= x[1:] != x[:-1]
            edges = [*np.flatnonzero(new).tolist(), len(node)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if at != (here := (component[lo], block[lo], longs[lo])):
                    at, held = here, []
                bits = _bits_of(rows.slice(lo, hi - lo), int(longs[lo]))
                if not query[lo]:
                    held.append((node[lo:hi].copy(), n[lo:hi].copy(), score[lo:hi].copy(), bits))
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held))]
                if not held:
                    continue
                nodes_, lengths, scores, known = held[0]
                for q in range(lo, hi):
                    ok, apart = _near_bits(lengths, n[q], known, bits[q - lo])
                    found = np.flatnonzero(ok)
                    if nearest is not None and len(found) > nearest:
                        found = found[np.argsort(apart[found], kind="stable")[:nearest]]
                    out += [(int(scores[m]), int(nodes_[m]), int(score[q]), int(node[q])) for m in found]
            yield _pair_batch(out)

    return run


def with_classes(rows: DataFrame, components: DataFrame, about: DataFrame, nearest: int | None) -> DataFrame:
    """(x, y), a pair perhaps at two widths: nodes of open keys with members of the big classes that they share a key with and are not of.

    A class and the texts that ask for it are each dealt into blocks, and each block of the
    one meets each of the other, so a pair is met once, however many keys it shares. With
    `nearest`, only the first block of a class is met, and only so many pairs of a text come out.
    """
    big = rows.where(F.col("members") >= BIG).select("key", F.col("component").alias("of"), F.col("members").alias("of_members")).distinct()
    pairs = rows.join(big, "key").where(F.col("component") != F.col("of")).where((F.col("members") < BIG) | (F.col("component") > F.col("of")))
    asked = materialise(pairs.select("node", "of", "of_members").distinct(), "near-asked")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = asked.groupBy("of").agg(F.max("of_members").alias("of_members"), F.count("*").alias("queries"))
    sizes = materialise(sizes.select(F.col("of").alias("component"), blocks("of_members").alias("rows"), blocks("queries").alias("columns")), "near-blocks")
    deal = lambda df, own, other: df.withColumn(own, F.pmod(F.hash("node"), F.col(f"{own}s"))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
    queries = deal(asked.select("node", F.col("of").alias("component")).join(sizes, "component"), "column", "row")
    members = deal(components.join(sizes, "component"), "row", "column")
    place = ["node", "component", (F.col("row") * F.col("columns") + F.col("column")).alias("block")]
    if nearest is not None:
        queries, members = queries.where("row = 0"), members.where("row = 0")
    queries, members = queries.select(*place, F.lit(True).alias("query")), members.select(*place, F.lit(False).alias("query"))
    dealt = _at_widths(queries.unionByName(members).join(about, "node")).select("component", "block", "width", "query", "node", "n", "score", "bits")
    dealt = dealt.repartition(tables.partitions(rows), "component", "block", "width").sortWithinPartitions("component", "block", "width", "query")
    return dealt.mapInArrow(class_pairs(nearest), "x long, y long")


def tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, key, low, high, block, node, n, score, component, bits, shares), sorted by tile (width, key, low, high), to the pairs of
    different components whose lengths and parities can match; of a tile of two blocks only pairs across them.

    shares are a node's keys that have tiles: a pair comes out under the least key that both share, and so once.
    """
    tile = ("width", "key", "low", "high")
    held: pa.Table | None = None

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        longs, key, low, high, block, node, n, score, component = (rows[c].to_numpy() for c in (*tile, "block", "node", "n", "score", "component"))
        new = np.zeros(len(key), bool)
        new[:1] = True
        for x in (longs, key, low, high):
            new[1:] |= x[1:] != x[:-1]
        start = np.flatnonzero(new)
        stop = np.repeat(np.append(start[1:], len(key)), np.diff(np.append(start, len(key))))
        edges = [*np.flatnonzero(np.concatenate([[True], longs[1:] != longs[:-1]])).tolist(), len(key)]
        for lo, hi in zip(edges[:-1], edges[1:]):  # rows of one width
            bits, left = _bits_of(rows.slice(lo, hi - lo), int(longs[lo])), np.arange(lo, hi)
            shares: dict[int, set[int]] = {}
            for shift in range(1, hi - lo):
                left = left[left + shift < stop[left]]
                if not len(left):
                    break
                i, k = left, left + shift
                ok = (component[i] != component[k]) & ((low[i] == high[i]) | (block[i] != block[k]))
                i, k = i[ok], k[ok]
                step = max(1, (1 << 20) // int(longs[lo]))
                for at in range(0, len(i), step):
                    x, y = i[at : at + step], k[at : at + step]
                    ok, _ = _near_bits(n[x], n[y], bits[x - lo], bits[y - lo])
                    x, y = x[ok], y[ok]
                    for i_ in {*x.tolist(), *y.tolist()} - shares.keys():
                        shares[i_] = set(rows["shares"][i_].as_py())
                    ok = np.array([min(shares[a] & shares[b]) == key[a] for a, b in zip(x.tolist(), y.tolist())], bool)
                    if ok.any():
                        x, y = x[ok], y[ok]
                        first = (score[x] > score[y]) | ((score[x] == score[y]) & (node[x] > node[y]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.where(first, node[x], node[y])), pa.array(np.where(first, node[y], node[x]))], ["x", "y"])

    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        last = np.logical_and.reduce([held[c].to_numpy() == held[c][-1].as_py() for c in tile])
        cut = int(np.argmax(last))  # the last tile may go on in the next batch
        if cut:
            yield from pairs(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield from pairs(held)


def in_tiles(rows: DataFrame, about: DataFrame) -> DataFrame:
    """(x, y), a pair perhaps at two widths: all possible pairs of nodes under an open key, of different components that are not big.

    A key of m nodes is dealt into m / TILE blocks, and each two blocks meet in one
    tile: no task holds more than a tile, whatever a key's share of the rows.
    """
    small = rows.where(F.col("members") < BIG)
    ends = small.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("nodes")).where("lo <> hi")
    blocks = F.ceil(F.col("nodes") / TILE).cast("int")
    mine = small.join(ends.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    shares = mine.groupBy("node").agg(F.collect_list("key").alias("shares"))  # as many as a text has keys, at most
    dealt = mine.join(about.select("node", "bits").join(shares, "node"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = ("width", "key", "low", "high")
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    tiles = _at_widths(dealt).select(*tile, "block", "node", "n", "score", "component", "bits", "shares")
    tiles = tiles.repartition(tables.partitions(rows), *tile).sortWithinPartitions(*tile)
    return tiles.mapInArrow(tile_pairs, "x long, y long")


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b): the pairs of nodes that alignment confirms.

    Only rows whose id stands among the wanted ones are read as words: marks of fixed
    size tell which may be such, and the join that follows is exact.
    """
    wanted = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    wanted = materialise(wanted.join(reps.select("node", "id", "a", "b"), "node"), "near-wanted")
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, first in _words(batch.column(1)):
                a, b = (pa.array(textkit.signed(x)) for x in nodes(words, first))
                rows = [words[first[i] : first[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), a, b, pa.array(rows, pa.binary())], ["id", "a", "b", "words"])

    near_rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    near_rows = tables.marked(near_rows, F.xxhash64("id"), wanted.select(F.xxhash64("id").alias("mark"))).where("marked")
    texts = near_rows.select("id", "text").mapInArrow(read, f"id {kind}, a long, b long, words binary")
    texts = texts.join(wanted.withColumnRenamed("id", "of"), ["a", "b"]).where(F.col("id").eqNullSafe(F.col("of"))).select("node", "words").dropDuplicates(["node"])
    texts = materialise(texts, "near-texts")
    left, right = texts.select(F.col("node").alias("x"), F.col("words").alias("wx")), texts.select(F.col("node").alias("y"), F.col("words").alias("wy"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [near(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], ["a", "b"])

    # the leader's words come first, to pairs without words, so that only one text of a pair is shuffled with it and pairs end up dealt out by their other ends
    joined = pairs.join(left, "x").repartition(tables.partitions(docs), "y").join(right, "y").select("x", "y", "wx", "wy")
    links = materialise(joined.mapInArrow(align, "a long, b long"), "near-links")
    discard(wanted, texts)
    return links


def linked(docs: DataFrame, reps: DataFrame, lone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of all nodes with a link."""
    shared_rows, about = shared(lone)
    tried = materialise(candidates(shared_rows, about), "near-pairs")
    components = connected_components(verified(docs, tried, reps, id_col, text_col))
    rows = shared_rows
    for nearest in (NEAREST, None):
        before, rows = rows, still_open(rows.select("key", "node", "n", "score"), components)  # what is open was open before
        discard(before)
        more = with_classes(rows, components, about, nearest)
        if nearest is not None:  # once: components only grow, so later tiles hold no pair that these did not
            more = more.unionByName(in_tiles(rows, about))
        more = materialise(more.distinct().join(tried, ["x", "y"], "left_anti"), "near-pairs")
        found = None if more.isEmpty() else verified(docs, more, reps, id_col, text_col)
        if found is not None and not found.isEmpty():
            components = connected_components(found.unionByName(components.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        tried = tried.unionByName(more)
    return components


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, class_id (the smallest id of its class), class_size, kept, a, b (the hash of its words)."""
    known = materialise(sketches(docs, id_col, text_col), "near-sketches")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    reps = known.groupBy("a", "b").agg(least.alias("r"), F.count("*").alias("copies"))
    reps = materialise(reps.select("a", "b", "copies", F.col("r.id").alias("id"), F.col("r.row").alias("node")), "near-nodes")
    lone = known.join(reps.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "n", "keys", "bits")
    components = linked(docs, reps, lone, id_col, text_col)
    members = components.join(reps, "node")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("node").alias("row")))
    whole = members.groupBy("component").agg(least.alias("r"), F.sum("copies").alias("class_size"))
    told = members.select("node", "component").join(whole, "component").select("node", F.col("r.id").alias("class_id"), F.col("r.row").alias("keep_row"), "class_size")
    told = reps.join(told, "node", "left").select("a", "b", F.when(F.col("keep_row").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("keep_row", "node").alias("keep_row"), F.coalesce("class_size", "copies").alias("class_size"))
    out = known.select("id", "row", "a", "b").join(told, ["a", "b"])
    return out.select("id", "class_id", "class_size", (F.col("row") == F.col("keep_row")).alias("kept"), "a", "b")


def _with_node(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, a, b): the rows of docs as structs, with the hash of their words."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nodes(words, first) for _, _, words, first in _words(batch.column(1))]
            ends = [np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.uint64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(textkit.signed(x)) for x in ends]], ["row", "a", "b"])

    shape = docs.select(row)
    hashes = [StructField(x, LongType()) for x in "ab"]
    return shape.withColumn("text", F.col("row").getField(text_col)).mapInArrow(run, StructType([*shape.schema.fields, *hashes]))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns and no others."""
    told = materialise(classes(docs, id_col, text_col), "near-told")
    fate = materialise(told.groupBy("id").agg(F.max("kept").alias("stays"), F.count("*").alias("copies")).where("not stays or copies > 1"), "near-fate")
    kept, doubtful = tables.split(docs, id_col, fate.select("id"))
    repeated = fate.where("stays").select("id")
    if repeated.isEmpty():
        return kept
    # rows with a repeated id are told apart by their words
    rows = _with_node(doubtful, text_col).withColumn("id", F.col("row").getField(id_col))
    stay = told.where("kept").select(F.col("id").alias("kept_id"), F.col("a").alias("kept_a"), F.col("b").alias("kept_b"))
    rows = rows.join(stay, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("a") == F.col("kept_a")) & (F.col("b") == F.col("kept_b")))
    one = rows.groupBy("id", "a", "b").agg(F.first("row").alias("row"))
    return kept.unionByName(one.select("row.*"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(tables.documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")
