"""Near-duplicate lines by an exact set-similarity join, and the texts without later matches.

A line is the set of its words (lower-cased runs of letters and digits). Two
lines match if the Jaccard similarity of their sets is at least SIMILARITY; of
matching lines the first in order of (id, line number) stays and every later one
goes, whether or not the earlier one stays itself. Lines without words stay.

Words are ordered by rarity - the logarithm of a count over all documents in BUCKETS
hashed counters, then the word's hash, so the order is the same everywhere. Matching
sets must share a word among their first n - ceil(SIMILARITY n) + 1 in that
order (prefix filter), have near sizes (length filter), and enough room behind
the shared word (positional filter); what passes is verified on the full sets.
A bitmap filter goes first: the parity of a set's words, in 64 bits and for longer
lines in 256, differs in no more bits than the sets differ in words.

Sets that share a key word are met in one sorted stream. A set needs one earlier
match only, so it is paired with the NEAREST earlier ones that pass all filters,
not with all; a set for which none of these holds although others were left
untried is tried against all of them in a second round. Earlier is meant by where a
set first stands, not by where a task read it; ids that are not integers are ordered
by their first bytes only, and then late sets go into the second round as well.
Equal sets are one node
from the start, so a line that stands everywhere makes no pairs. Words that only
one line has are no keys; sets of under four words match only equal ones.

Null texts count as empty; null ids are last; rows that repeat both id and text
count as one document and get one result. Texts are split at line feeds, and the
kept lines are joined by them again. Very long texts and lines are read whole, an
empty table gives no rows, and extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gaugeline.llm import tables, textkit
from gaugeline.scratch import discard, materialise

SIMILARITY = 0.8
BUCKETS = 1 << 20
#: Of a count's logarithm, for each doubling: small counts keep their order, and 2 ** 40 fits into 16 bits.
STEPS = 1600
#: Passing earlier sets that a set is first paired with.
NEAREST = 3
#: Words from which a set has the wide bitmap in the first round; in the second all have it.
WIDE = 72
#: Key buckets of a partition: a task holds the rows of one bucket at a time.
SPLIT = 16
_KEY = np.dtype([("key", "<u4"), ("place", "<u2")])
_ROW = np.dtype([("key", "<u4"), ("place", "<u2"), ("n", "<u4"), ("line", "<i4"), ("a", "<u8"), ("bits", "<u8"), ("order", "<i8"), ("th", "<i8")])
#: Bits of the filter that tells which lines verification needs, in 2 ** FILTER bits.
FILTER = 23
LEAST = 4


def _lines(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row from, to, row of each line, number of the line in its row, word hashes, first word of each line); lines without words are left out."""
    for lo, hi in textkit.chunks(texts):
        data, offsets = textkit.buffers(pc.utf8_lower(texts.slice(lo, hi - lo)))
        feed = data == 10
        fed = np.concatenate([[0], np.cumsum(feed, dtype=np.int32)])  # feeds before each byte
        count = 1 + fed[offsets[1:]] - fed[offsets[:-1]]
        row = np.repeat(np.arange(hi - lo), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        starts, ends, first = textkit.words(data, offsets, textkit.NOT_ALNUM)
        words = textkit.word_hashes(data, starts, ends)
        of_row = np.repeat(np.arange(hi - lo), np.diff(first))
        line = fed[starts] + of_row  # each row before adds one line that no feed counts
        yield lo, hi, row, number, words, line


def _sets(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's different words, by line and hash."""
    return _ranked(words, line, np.zeros(len(words), np.uint16))[:2]


def _ranked(words: np.ndarray, line: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's different words, by line, rarity and hash."""
    packed = line.astype(np.uint64) << np.uint64(40) | rare.astype(np.uint64) << np.uint64(24) | words >> np.uint64(40)
    order = np.argsort(packed)
    packed, w = packed[order], words[order]
    tied = packed[1:] == packed[:-1]
    if (tied & (w[1:] != w[:-1])).any() or (len(line) and line[-1] >= 1 << 24):  # what the packed bits cannot tell
        order = np.lexsort((words, rare, line))
        w = words[order]
    n = line[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (n[1:] != n[:-1])
    return w[new], n[new], rare[order][new]


def _set_hash(words: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits and the size of each line's set."""
    size = np.bincount(line, minlength=lines)
    edge = np.concatenate([[0], np.cumsum(size)])
    out = []
    for salt in (0x51ED27, 0xA24BAE):
        total = np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(words + np.uint64(salt)), dtype=np.uint64)])
        out.append(textkit.mix(total[edge[1:]] - total[edge[:-1]] + size.astype(np.uint64)))
    return out[0], out[1], size


def rarity(texts: DataFrame) -> np.ndarray:
    """How often each bucket's words stand in all texts, as 0 or 1 + round(STEPS * log2 of it); a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for lo, hi in textkit.chunks(batch.column(0)):
                data, offsets = textkit.buffers(pc.utf8_lower(batch.column(0).slice(lo, hi - lo)))
                starts, ends, _ = textkit.words(data, offsets, textkit.NOT_ALNUM)
                held.append((textkit.word_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64))
                size += len(starts)
                if size >= BUCKETS:
                    counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        for at in range(0, len(used), 1 << 16):
            some = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    level = 1 + F.round(STEPS * F.log2(F.sum("n")))
    got = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(level.cast("int").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.uint16)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def _parity(words: np.ndarray, edge: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Bits in which each line has an odd number of words: 256 in four columns."""
    out = np.zeros((len(edge) - 1, 4), np.uint64)
    if len(some):
        bit = np.uint64(1) << (words >> np.uint64(58))
        part = words >> np.uint64(56) & np.uint64(3)
        for k in range(4):
            out[some, k] = np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), edge[:-1][some])
    return out


def line_sets(docs: DataFrame, counts: np.ndarray, kind: str) -> DataFrame:
    """(id, th, line, a, b, n, bits, wide, keys) of each line with words; keys, its prefix, only where a set is new to its task."""
    shipped = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, row, number, words, line in _lines(batch.column(2)):
                w, of, rare = _ranked(words, line, shipped.value[(words % np.uint64(BUCKETS)).astype(np.int64)])
                a, b, size = _set_hash(w, of, len(row))
                edge = np.concatenate([[0], np.cumsum(size)])
                some = np.flatnonzero(size)
                parity = _parity(w, edge, some)
                bits = parity[:, 0] ^ parity[:, 1] ^ parity[:, 2] ^ parity[:, 3]
                shared = rare > 1
                prefix = size - np.ceil(SIMILARITY * size - 1e-9).astype(np.int64) + 1
                short = np.empty(len(w), _KEY)
                short["key"] = (w & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                short["place"] = np.minimum(np.arange(len(w)) - edge[of], 0xFFFF)
                use = shared & (np.arange(len(w)) - edge[of] < prefix[of]) & (size[of] >= LEAST)
                short, at = short[use], np.concatenate([[0], np.cumsum(np.bincount(of[use], minlength=len(row)))])
                keys, wide = [], []
                for i in some.tolist():
                    fresh = at[i + 1] > at[i] and (node := int(a[i])) not in seen
                    if fresh and len(seen) < 1 << 17:  # what it forgets is only found again
                        seen.add(node)
                    keys.append(short[at[i] : at[i + 1]].tobytes() if fresh else None)
                    wide.append(parity[i].tobytes() if fresh else None)
                rows = pa.array(lo + row[some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(x[some]) for x in (number.astype(np.int32), textkit.signed(a), textkit.signed(b), size.astype(np.int32), textkit.signed(bits))], pa.array(wide, pa.binary()), pa.array(keys, pa.binary())],
                    ["id", "th", "line", "a", "b", "n", "bits", "wide", "keys"],
                )

    return docs.mapInArrow(run, f"id {kind}, th long, line int, a long, b long, n int, bits long, wide binary, keys binary")


def _order(ids: pa.Array) -> np.ndarray:
    """64 bits that sort like the ids, exactly for integers and by the first bytes of others; null last."""
    if pa.types.is_integer(ids.type):
        return pc.fill_null(ids.cast(pa.int64()), 2**63 - 1).to_numpy(zero_copy_only=False)
    return np.array([2**63 - 1 if x is None else int.from_bytes(str(x).encode()[:7].ljust(7, b"\0")) for x in ids.to_pylist()], np.int64)


def _bits(values: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** FILTER bits, built by Spark, of a column of longs."""
    place = F.pmod(F.col(values.columns[0]), F.lit(1 << FILTER)) + 1  # Spark's bitmaps count from 1
    parts = values.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(1 << FILTER, bool)
    for r in parts.collect():  # at most 2 ** FILTER bits in all
        at = (int(r["part"]) - 1) * 32768
        out[at : at + 32768] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
    return out


def tied(lines: DataFrame) -> bool:
    """Whether some id has two texts or is null, so that ids alone do not order documents."""
    texts = lines.groupBy("id").agg(F.min("th").alias("least"), F.max("th").alias("most"))
    return not texts.where("id is null or least <> most").isEmpty()


def prefixes(firsts: DataFrame, only: np.ndarray | None = None, wide_from: int = WIDE, with_texts: bool = True) -> DataFrame:
    """(bucket, rows, wide): the words by which sets meet, packed by bucket of the word; only: a bitmap of words.

    Without texts their hashes are left at zero, which a shuffle compresses away: for ids that are whole numbers, none of them tied.
    """
    buckets = tables.partitions(firsts) * SPLIT
    shipped = firsts.sparkSession.sparkContext.broadcast(None if only is None else np.packbits(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = None if shipped.value is None else np.unpackbits(shipped.value).astype(bool)
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                a, n, bits, wide, ids, th, line, keys = (whole.column(i).slice(at, 5000) for i in range(8))
                packed = keys.to_pylist()
                short = np.frombuffer(b"".join(packed), _KEY)
                of = np.repeat(np.arange(len(packed)), [len(x) // _KEY.itemsize for x in packed])
                if use is not None:
                    some = use[short["key"] % (1 << FILTER)]
                    short, of = short[some], of[some]
                bucket = short["key"] % buckets
                order = np.argsort(bucket, kind="stable")
                short, of, bucket = short[order], of[order], bucket[order]
                rows = np.zeros(len(short), _ROW)
                rows["key"], rows["place"] = short["key"], short["place"]
                for name, column in (("n", n), ("line", line), ("a", a), ("bits", bits), *([("th", th)] if with_texts else [])):
                    rows[name] = column.to_numpy(zero_copy_only=False)[of].astype(_ROW[name], casting="unsafe")
                rows["order"] = _order(ids)[of]
                bitmaps = [x if k >= wide_from else b"" for x, k in zip(wide.to_pylist(), n.to_pylist())]
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                ends = np.append(edge[1:], len(bucket))
                blobs = [rows[i:j].tobytes() for i, j in zip(edge, ends)]
                wides = [b"".join(bitmaps[k] for k in of[i:j].tolist()) for i, j in zip(edge, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(wides, pa.binary())], ["bucket", "rows", "wide"])

    placed = firsts.where("keys is not null").select("a", "n", "bits", "wide", "first.id", "first.th", "first.line", "keys")
    return placed.select("a", "n", "bits", "wide", "id", "th", "line", "keys").mapInArrow(run, "bucket int, rows binary, wide binary")


def _passes(nx, px, ny, py, bx, by) -> np.ndarray:
    """Length, positional and bitmap filters; x and y in any order."""
    need = np.ceil(SIMILARITY / (1 + SIMILARITY) * (nx + ny) - 1e-9)
    room = np.minimum(nx - px, ny - py) + np.minimum(px, py)
    near = np.minimum(nx, ny) >= SIMILARITY * np.maximum(nx, ny) - 1e-9
    return near & (room >= need) & (np.bitwise_count(bx ^ by) <= nx + ny - 2 * need)


def _by_place(rows: np.ndarray) -> np.ndarray:
    """The order by key, id, th and line; by one number where these fit into 64 bits and no id has two texts."""
    key, order, th, line = (np.ascontiguousarray(rows[c]) for c in ("key", "order", "th", "line"))
    if len(rows):
        since = order - order.min()
        bits = [int(x.max()).bit_length() for x in (key, since, line)]
        if sum(bits) <= 63 and since.min() >= 0:
            found = np.argsort(key.astype(np.int64) << (bits[1] + bits[2]) | since << bits[2] | line)
            k, o, t = key[found], order[found], th[found]
            if not ((k[1:] == k[:-1]) & (o[1:] == o[:-1]) & (t[1:] != t[:-1])).any():
                return found
    return np.lexsort((rows["a"], line, th, order, key))


def _meet(rows: np.ndarray, wide: np.ndarray, nearest: int, only: np.ndarray | None, wide_from: int) -> Iterator[pa.RecordBatch]:
    """(x, y, more) of one bucket's rows: each set with the nearest sets before it that pass the filters; only: a bitmap of sets to look for."""
    where = np.full(len(rows), -1)
    long = np.flatnonzero(rows["n"] >= wide_from)
    where[long] = np.arange(len(long))
    order = _by_place(rows)
    rows, where = rows[order], where[order]
    new = np.ones(len(rows), bool)
    new[1:] = rows["key"][1:] != rows["key"][:-1]
    under, of = np.cumsum(new), np.ascontiguousarray(rows["a"])
    same = np.lexsort((of, under))  # stable: of equal sets under a word the first row stays
    first = np.ones(len(same), bool)
    first[1:] = (under[same][1:] != under[same][:-1]) | (of[same][1:] != of[same][:-1])
    stays = np.sort(same[first])
    rows, where = rows[stays], where[stays]
    key, a, bits = (np.ascontiguousarray(rows[c]) for c in ("key", "a", "bits"))
    n, place = rows["n"].astype(np.int64), rows["place"].astype(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    before = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))  # earlier rows of the key
    left, lag = np.flatnonzero(before > 0), 1
    if only is not None:
        left = left[only[(a[left] % np.uint64(1 << FILTER)).astype(np.int64)]]
    made = np.zeros(len(key), np.int64)
    apart_most = np.minimum((1 - SIMILARITY) / (1 + SIMILARITY) * (1 + 1 / SIMILARITY) * n + 1, 65).astype(np.uint8)  # with any size that can match
    while len(left):
        y = left[np.bitwise_count(bits[left] ^ bits[left - lag]) <= apart_most[left]]
        x = y - lag
        ok = _passes(n[x], place[x], n[y], place[y], bits[x], bits[y])
        y, x = y[ok], x[ok]
        both = (where[x] >= 0) & (where[y] >= 0)
        if both.any():
            need = np.ceil(SIMILARITY / (1 + SIMILARITY) * (n[x] + n[y]) - 1e-9)
            apart = np.bitwise_count(wide[where[x[both]]] ^ wide[where[y[both]]]).sum(1)
            keep = np.ones(len(x), bool)
            keep[both] = apart <= (n[x] + n[y] - 2 * need)[both]
            y, x = y[keep], x[keep]
        made[y] += 1
        lag += 1
        if len(y):
            yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(a[x])), pa.array(textkit.signed(a[y])), pa.array((made[y] >= nearest) & (before[y] >= lag))], ["x", "y", "more"])
        left = left[(before[left] >= lag) & (made[left] < nearest)]


def candidates(packed: DataFrame, nearest: int = NEAREST, only: np.ndarray | None = None, wide_from: int = WIDE) -> DataFrame:
    """(x, y, more): sets by first hash, x before y; more if earlier ones were left untried."""
    shipped = packed.sparkSession.sparkContext.broadcast(None if only is None else np.packbits(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, wide = None, [], []
        use = None if shipped.value is None else np.unpackbits(shipped.value).astype(bool)

        def done() -> Iterator[pa.RecordBatch]:
            yield from _meet(np.frombuffer(b"".join(rows), _ROW), np.frombuffer(b"".join(wide), np.uint64).reshape(-1, 4), nearest, use, wide_from)

        for batch in batches:
            for bucket, r, w in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket != now and rows:
                    yield from done()
                    rows, wide = [], []
                now = bucket
                rows.append(r)
                wide.append(w)
        if rows:
            yield from done()

    at_home = packed.repartition(tables.partitions(packed), "bucket").sortWithinPartitions("bucket")
    return at_home.mapInArrow(run, "x long, y long, more boolean").groupBy("x", "y").agg(F.max("more").alias("more"))


def verified(docs: DataFrame, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(ax, bx, ay, by) of pairs whose full sets reach the similarity.

    Only lines where a set of a pair first stands are read: two bitmaps of fixed
    size tell which documents and lines may be such, and the join that follows is exact.
    """
    spark = docs.sparkSession
    ends = pairs.select(F.col("x").alias("a")).unionByName(pairs.select(F.col("y").alias("a"))).distinct()
    wanted = materialise(ends.join(firsts, "a").select("a", "first.th", "first.line"), "line-wanted")
    by_document, by_line = _bits(wanted.select("th")), _bits(wanted.select(F.col("th").bitwiseXOR(F.shiftleft(F.col("line").cast("long"), 7)).alias("at")))
    shipped = spark.sparkContext.broadcast((np.packbits(by_document), np.packbits(by_line)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_document, in_line = (np.unpackbits(x).astype(bool) for x in shipped.value)
        seen: set[tuple[int, int]] = set()  # copies of a line that this task has given out; what it forgets is dropped later
        for whole in batches:
            batch = whole.filter(pa.array(in_document[whole.column(1).to_numpy() % (1 << FILTER)]))
            th = batch.column(1).to_numpy()
            for lo, hi, row, number, words, line in _lines(batch.column(2)):
                use = in_line[(th[lo:hi][row] ^ number << 7) % (1 << FILTER)]
                some = use[line]
                w, of = _sets(words[some], line[some])
                a, b, size = _set_hash(w, of, len(row))
                edge = np.concatenate([[0], np.cumsum(size)])
                new = []
                for i in np.flatnonzero(size).tolist():
                    if (node := (int(a[i]), int(b[i]))) not in seen:
                        new.append(i)
                        if len(seen) < 1 << 17:
                            seen.add(node)
                full = np.array(new, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(a)[full]), pa.array(textkit.signed(b)[full]), pa.array([w[edge[i] : edge[i + 1]].tobytes() for i in full.tolist()], pa.binary())], ["a", "b", "words"])

    sets = docs.mapInArrow(read, "a long, b long, words binary").dropDuplicates(["a", "b"]).join(wanted.select("a").distinct(), "a", "left_semi")
    sets = materialise(sets, "line-words")

    def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for p, q in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= SIMILARITY * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in range(4)], ["ax", "bx", "ay", "by"])

    x, y = (sets.select(F.col("a").alias(f"a{s}"), F.col("b").alias(f"b{s}"), F.col("words").alias(f"w{s}")) for s in "xy")
    joined = pairs.join(y, F.col("y") == F.col("ay")).join(x, F.col("x") == F.col("ax")).select("ax", "bx", "ay", "by", "wx", "wy")
    return joined.mapInArrow(jaccard, "ax long, bx long, ay long, by long")


def later_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, gone): numbers of the lines that go, from 0; documents that lose none do not appear."""
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(tables.text_of(text_col)).alias("th"), F.col(text_col).alias("text"))
    counts = rarity(named.select("text"))
    lines = materialise(line_sets(named, counts, kind), "lines")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th", "line")
    # where a set first stands, with its prefix from whichever task found it new: a set meets others once, and is shuffled with its prefix once
    known = [F.max(c).alias(c) for c in ("n", "bits", "wide", "keys")]
    firsts = materialise(lines.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("rows"), *known), "line-firsts")
    whole = lines
    lines = materialise(whole.select("id", "th", "line", "a", "b"), "lines")
    discard(whole)  # prefixes and bitmaps are in firsts now
    numbered = isinstance(docs.schema[id_col].dataType, IntegralType)
    with_texts = not numbered or tied(lines)
    pairs = materialise(candidates(prefixes(firsts, with_texts=with_texts)), "line-pairs")
    late = _later(verified(named, pairs.select("x", "y"), firsts), firsts)
    # sets that none of their nearest candidates matches, though more were there: against all, with the wide bitmap for every size
    open_y = pairs.groupBy("y").agg(F.max("more").alias("more")).where("more")
    if numbered:  # the order in which sets met is that of firsts
        open_y = open_y.join(late.select(F.col("a").alias("y")), "y", "left_anti")
    open_y = materialise(open_y.select(F.col("y").alias("a")), "line-open")
    if open_y.count():
        packed = prefixes(firsts, _keys_of(firsts, open_y), wide_from=0, with_texts=with_texts)
        again = candidates(packed, 1 << 30, _bits(open_y), wide_from=0).select("x", "y").join(open_y.withColumnRenamed("a", "y"), "y", "left_semi")
        again = materialise(again.join(pairs.select("x", "y"), ["x", "y"], "left_anti"), "line-pairs")
        late = materialise(late.unionByName(_later(verified(named, again, firsts), firsts)).distinct(), "line-late")
    fate = materialise(firsts.select("a", "b", "first", "rows").join(late.withColumn("late", F.lit(True)), ["a", "b"], "left").where("late or rows > 1"), "line-fate")
    told = tables.join_hot(lines, fate, ["a", "b"], "rows", ["first", "late"])
    gone = told.where(F.coalesce("late", F.lit(False)) | (place != F.col("first")))
    return gone.groupBy("id", "th").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def _keys_of(firsts: DataFrame, sets: DataFrame) -> np.ndarray:
    """A bitmap of the key words of some sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column(0).to_pylist()), _KEY)["key"].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])

    return _bits(firsts.where("keys is not null").join(sets, "a", "left_semi").select("keys").mapInArrow(run, "key long"))


def _later(links: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b) of the later set of each link."""
    for s in "xy":
        links = links.join(firsts.select(F.col("a").alias(f"a{s}"), F.col("b").alias(f"b{s}"), F.col("first").alias(f"f{s}")), [f"a{s}", f"b{s}"])
    later = F.when(F.col("fx") < F.col("fy"), F.struct(F.col("ay").alias("a"), F.col("by").alias("b"))).otherwise(F.struct(F.col("ax").alias("a"), F.col("bx").alias("b")))
    return materialise(links.select(later.alias("l")).select("l.*").distinct(), "line-late")


def drop_later_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str | None = None, gone_col: str | None = None) -> DataFrame:
    """The rows of docs with the kept lines as text; lines_col and gone_col name columns to add: how many lines there were and how many went.

    Columns of docs that have these names are replaced.
    """
    docs = tables.without(docs, text_col, lines_col, gone_col)
    gone = materialise(later_matches(docs, id_col, text_col), "line-gone")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mine = docs.select(row, F.col(id_col).alias("id"), F.xxhash64(tables.text_of(text_col)).alias("th"))
    other = gone.select(F.col("id").alias("of"), F.col("th").alias("with"), "gone")
    found = mine.join(other, F.col("th").eqNullSafe(F.col("with")) & F.col("id").eqNullSafe(F.col("of")), "left")
    lines = F.split(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).otherwise(kept)
    columns = [(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    for name, value in ((lines_col, F.size(lines)), (gone_col, F.coalesce(F.size("gone"), F.lit(0)))):
        if name:
            columns.append(value.cast("long").alias(name))
    return found.select(*columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: lines, how many go, and their numbers from 0; drop_later_lines() rewrites the texts."""
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    gone = later_matches(docs).withColumnRenamed("id", "of").withColumnRenamed("th", "with")
    text = tables.text_of("text")
    lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    mine = docs.select("doc_id", F.xxhash64(text).alias("th"), lines.alias("n_lines"))
    found = mine.join(gone, F.col("th").eqNullSafe(F.col("with")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    removed = F.coalesce("gone", F.expr("cast(array() as array<int>)"))
    return found.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
