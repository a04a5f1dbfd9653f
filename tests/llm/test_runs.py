"""Runs against a search by definition, and the whole query against plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from gaugeline.llm import runs
from tests.llm.conftest import frame, words


def brute(w):
    """Every (start, length, period) by the definition."""
    n, found = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(12, 2 * q):
                part = w[i : i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def sample(seed):
    pick = random.Random(seed)
    letters = "abcdefghij"[: pick.randrange(1, 8)]
    w = []
    while len(w) < pick.randrange(5, 160):
        base = [pick.choice(letters) for _ in range(pick.randrange(1, 20))]
        w += (base * pick.randrange(1, 5))[: pick.randrange(1, 60)]
    return [x.encode() for x in w]


@pytest.mark.parametrize("part", range(8))
def test_runs_by_definition(part):
    for seed in range(part * 60, part * 60 + 60):
        w = sample(seed)
        assert runs.runs_of(w) == brute(w), seed


def test_one_word_over_and_over():
    assert runs.runs_of([b"a"] * 11) == []
    assert runs.runs_of([b"a"] * 12) == [(0, 12, 1)]
    assert runs.collapsed([b"a"] * 12, [(0, 12, 1)]) == b"a"
    assert runs.runs_of([b"a"] * 3000) == [(0, 3000, 1)]


def test_lags_end_where_nothing_comes_again():
    w = [str(i).encode() for i in range(5000)]
    assert runs.longest_lag(runs.numbered(w)) == 0
    assert runs.longest_lag(runs.numbered(w[:40] * 3)) == 60


def test_long_period():
    w = [x.encode() for x in words(3, 700)]
    w = w[:300] + w[300:] * 2 + [b"end"]
    assert runs.runs_of(w) == [(300, 800, 400)]


def expected(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in found), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    row = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *row, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_brute_force(spark, tables):
    texts = [" ".join(x.decode() for x in sample(i)) for i in range(60)] + [None, "", " \t", "a  b c\x85d\n", "é " * 30, "x y\x1c z " * 12, " ".join(words(9, 300))]
    ids = [*range(len(texts))]
    texts += [texts[0]] * 2
    ids += [None, 0]
    docs = frame(spark, texts, ids)
    rows = runs.op13_runs(spark, tables(documents=docs)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, rows), key=key) == sorted((expected(i, t) for i, t in zip(ids, texts)), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids if i is not None) >= 3


def test_odd_rows_and_empty(spark, odd, empty):
    out = runs.find_runs(odd, runs="ids", text="row")
    assert set(out.columns) == set(odd.columns) and out.count() == odd.count()
    texts = {r.doc_id: r.row for r in out.collect()}
    assert texts[0] == texts[1] == texts[2] == "" and texts[9] == "one two three four five six"
    assert runs.find_runs(empty).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(odd, runs="text")
