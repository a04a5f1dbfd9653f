"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

A vocabulary's pieces get log scores from their rank (Zipf's law: the score of
rank r is -log r, less the normaliser), whatever merge ranks the file holds, and
the segmentation with the largest sum of scores is found exactly. A character
that no piece covers costs a fixed penalty and is written as its UTF-8 bytes.

White space is marked as in the vocabulary: a text gets one leading space and
each space is the marker. Here the trie itself is built with the byte 0x20 in
the marker's place, so a marker character that stands in a text is no space but
falls back to its bytes: decoding restores every text exactly. No piece has a
space behind another character (this is checked), so a text splits into runs of
spaces with what follows; each different one is solved once, all of them
together in vectorised steps over the trie, and long ones one by one.

Null counts as empty; an empty text has no pieces. Repeated rows are encoded alike.
Very long texts are encoded whole, an empty table gives no rows, and extra columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from gaugeline.llm import tables, textkit

MARKER = "▁"
#: Below the worst score of a piece, for a character that none covers.
PENALTY = 10.0
#: Segments of more bytes are solved one by one.
TOGETHER = 48
_SPACE = 0x20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class DoubleArray:
    """Bytes to states: t = base[s] + byte + 1 is the next state if check[t] == s; value[t] is a piece's id or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for key, value in sorted(keys.items()):
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = value
        size = 4 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        free, dense, queue = 1, 0, [(0, 0)]
        for node, state in queue:
            value[state] = ends[node]
            codes = sorted(children[node])
            if not codes:
                continue
            if len(codes) == 1:  # most nodes: the next free place
                while used[free] or free <= codes[0]:
                    free += 1
                at = free - codes[0] - 1
            else:  # first fit, from where it last took long to find one
                at = dense
                while any(used[at + c + 1] for c in codes):
                    at += 1
                if at - dense > 256:
                    dense = at
            base[state] = at
            for c in codes:
                t = at + c + 1
                used[t] = 1
                check[t] = state
                queue.append((children[node][c], t))
        self.base, self.check, self.value = base, check, value


class Codec:
    """A vocabulary ready to encode and decode."""

    def __init__(self, pieces: list[tuple[bytes, int, float]], byte_ids: list[int], size: int):
        """pieces: (bytes with 0x20 for the marker, id, log score); byte_ids: id of each byte."""
        if any(b" " in p.lstrip(b" ") for p, _, _ in pieces):
            raise ValueError("a piece has a space behind another character: texts cannot be split at spaces")
        self.trie = DoubleArray({p: i for p, i, _ in pieces})
        self.score = np.full(size, -math.inf)
        self.score[[i for _, i, _ in pieces]] = [s for _, _, s in pieces]
        self.unknown = min(s for _, _, s in pieces) - PENALTY
        self.byte_ids = np.array(byte_ids, np.int32)
        self.bytes = [b""] * size
        for p, i, _ in pieces:
            self.bytes[i] = p
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        self.longest = max(len(p) for p, _, _ in pieces)
        self.width = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(self.width)])

    @classmethod
    def load(cls, path: str | None = None) -> Codec:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        plain.sort(key=lambda i: (-model.get_score(i), i))
        normaliser = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
        pieces = [(model.id_to_piece(i).replace(MARKER, " ").encode(), i, -math.log(r) - normaliser) for r, i in enumerate(plain, 1)]
        return cls(pieces, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], n)

    def _solve_one(self, text: bytes) -> list[int]:
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        n = len(text)
        best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            wide = 1 if text[at] < 0x80 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
            state, single = 0, False
            for stop in range(at + 1, min(n, at + self.longest) + 1):
                t = base[state] + text[stop - 1] + 1
                if check[t] != state:
                    break
                state = t
                if value[state] >= 0:
                    single |= stop == at + wide
                    if best[at] + score[value[state]] > best[stop]:
                        best[stop], back[stop] = best[at] + score[value[state]], (at, value[state])
            if not single and best[at] + self.unknown > best[at + wide]:
                best[at + wide], back[at + wide] = best[at] + self.unknown, (at, -1)
            at += wide
        out: list[int] = []
        while n:
            begin, piece = back[n]
            out += [piece] if piece >= 0 else self.byte_ids[list(text[begin:n])][::-1].tolist()
            n = begin
        return out[::-1]

    def _solve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments of at most TOGETHER bytes: a row each, right-aligned, and how many."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        u, size = len(starts), ends - starts
        longest = int(size.max())
        text = np.zeros((longest, u), np.int32)
        for i in range(longest):
            some = size > i
            text[i, some] = data[starts[some] + i]
        wide = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        best = np.full((longest + 1, u), -math.inf)
        best[0] = 0.0
        step, piece = np.zeros((longest + 1, u), np.int32), np.zeros((longest + 1, u), np.int32)
        for at in range(longest):
            begins = np.flatnonzero((size > at) & ((text[at] & 0xC0) != 0x80))
            rows, state = begins, np.zeros(len(begins), np.int32)
            lacks = np.zeros(u, bool)
            lacks[begins] = True
            for stop in range(at + 1, min(longest, at + self.longest) + 1):
                inside = size[rows] >= stop
                rows, state = rows[inside], state[inside]
                t = base[state] + text[stop - 1, rows] + 1
                ok = check[t] == state
                rows, state = rows[ok], t[ok]
                if not len(rows):
                    break
                found = value[state]
                ends_here = found >= 0
                r, f = rows[ends_here], found[ends_here]
                lacks[r[wide[at, r] == stop - at]] = False
                total = best[at, r] + self.score[f]
                better = total > best[stop, r]
                r, f = r[better], f[better]
                best[stop, r], step[stop, r], piece[stop, r] = total[better], stop - at, f
            rows = np.flatnonzero(lacks)
            if len(rows):
                w = wide[at, rows]
                better = best[at, rows] + self.unknown > best[at + w, rows]
                rows, w = rows[better], w[better]
                best[at + w, rows] = best[at, rows] + self.unknown
                for k in range(w.max(initial=0)):  # the bytes of the character, one id each
                    r = rows[w > k]
                    piece[at + k + 1, r], step[at + k + 1, r] = self.byte_ids[text[at + k, r]], 1
        out, count, left = np.zeros((u, longest), np.int32), np.zeros(u, np.int64), size.copy()
        rows = np.flatnonzero(left)
        while len(rows):
            count[rows] += 1
            out[rows, longest - count[rows]] = piece[left[rows], rows]
            left[rows] -= step[left[rows], rows]
            rows = rows[left[rows] > 0]
        return out, count

    @staticmethod
    def _told_apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments of one hash are compared by their bytes; one that differs from the first of its hash is solved by itself."""
        size, model = ends - starts, first[which]
        other = size != size[model]
        shift = np.repeat(np.where(other, 0, starts[model] - starts), size)  # segments follow one another without a gap
        at = np.arange(starts[0], ends[-1])
        other[np.repeat(np.arange(len(starts)), size)[data[at] != data[at + shift]]] = True
        alone = np.flatnonzero(other)
        which = which.copy()
        which[alone] = len(first) + np.arange(len(alone))
        return np.concatenate([first, alone]), which

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = textkit.buffers(texts)
        size = np.diff(offsets)
        full = size > 0
        room = offsets + np.concatenate([[0], np.cumsum(full)])  # one space in front of each text
        padded = np.full(room[-1], _SPACE, np.uint8)
        padded[np.arange(len(data)) + np.repeat(np.cumsum(full), size)] = data
        space = padded == _SPACE
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[room[:-1][full]] = True
        starts = np.flatnonzero(begin)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        ends = np.concatenate([starts[1:], [len(padded)]])
        _, first, which = np.unique(textkit.word_hashes(padded, starts, ends), return_index=True, return_inverse=True)
        first, which = self._told_apart(padded, starts, ends, first, which)
        s, e = starts[first], ends[first]
        found: list[np.ndarray] = [np.zeros(0, np.int32)]
        place, count, at = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), 0
        low = 0
        for high in (8, 16, TOGETHER):
            rows = np.flatnonzero((e - s > low) & (e - s <= high))
            low = high
            if len(rows):
                ids, n = self._solve(padded, s[rows], e[rows])
                found.append(ids[np.arange(ids.shape[1])[None, :] >= ids.shape[1] - n[:, None]])
                count[rows] = n
                place[rows] = at + np.cumsum(n) - n
                at += n.sum()
        for i in np.flatnonzero(e - s > TOGETHER):
            ids = np.array(self._solve_one(padded[s[i] : e[i]].tobytes()), np.int32)
            found.append(ids)
            count[i], place[i], at = len(ids), at, at + len(ids)
        flat, n = np.concatenate(found), count[which]
        total = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.arange(total[-1]) + np.repeat(place[which] - total[:-1], n)]
        return out, total[np.searchsorted(starts, room)]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        values, offsets, at = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        for lo, hi in textkit.chunks(texts, 1 << 19):
            ids, o = self._encode(texts.slice(lo, hi - lo))
            values.append(ids)
            offsets.append(o[1:] + at)
            at += len(ids)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(np.concatenate(values)))

    def _raw(self, ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, and where each begins; the space in front of a text is still there."""
        offsets = np.asarray(ids.offsets).astype(np.int64)
        values = np.asarray(ids.values)[offsets[0] : offsets[-1]] if len(ids) else np.zeros(0, np.int32)
        n = self.width[values]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.arange(total[-1]) + np.repeat(self.begin[values] - total[:-1], n)], total[offsets - offsets[0]]

    def restores(self, ids: pa.ListArray, texts: pa.Array) -> np.ndarray:
        """Whether decoding gives the text, for each row, by their bytes."""
        raw, at = self._raw(ids)
        data, offsets = textkit.buffers(texts)
        size = np.diff(at)
        same = np.maximum(size - 1, 0) == np.diff(offsets)
        rows = np.flatnonzero(same & (size > 0))
        for i in rows[[not np.array_equal(raw[at[i] + 1 : at[i + 1]], data[offsets[i] : offsets[i + 1]]) or raw[at[i]] != _SPACE for i in rows]]:
            same[i] = False
        return same

    def decode(self, ids: pa.ListArray) -> list[str]:
        """Texts of id lists; control ids are silent, bytes that are no UTF-8 become the replacement character."""
        flat, at = self._raw(ids)
        raw = flat.tobytes()
        return [raw[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    """Built once on the driver for each vocabulary."""
    return Codec.load(path)


def encode(docs: DataFrame, text_col: str = "text", name: str = "ids", vocabulary: str | None = None, check: str | None = None) -> DataFrame:
    """The rows of docs with the ids of their pieces; check names a column that says whether decoding gives the text.

    Columns of docs that have these names are replaced, all others are kept.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(codec(vocabulary))
    docs = tables.without(docs, text_col, name, check)
    at = docs.columns.index(text_col)
    extra = [StructField(name, ArrayType(IntegerType()))] + ([StructField(check, BooleanType())] if check else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in textkit.chunks(whole.column(at), 1 << 18):  # rows of ids are wide: small batches bound memory
                batch = whole.slice(lo, hi - lo)
                texts = batch.column(at)
                ids = shipped.value.encode(texts)
                new = [ids]
                if check:
                    new.append(pa.array(shipped.value.restores(ids, texts)))
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *[f.name for f in extra]])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *extra]))


def decode(rows: DataFrame, ids_col: str = "ids", name: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """The rows with the texts of their ids; null ids count as none, and a column of that name is replaced."""
    shipped = rows.sparkSession.sparkContext.broadcast(codec(vocabulary))
    rows = tables.without(rows, ids_col, name)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            ids = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int32())) if column.null_count else column
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shipped.value.decode(ids), pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, StringType())]))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, and whether decoding them gives the text."""
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    return encode(docs, check="exact").selectExpr("doc_id", "size(ids) as n_ids", "ids", "exact")
