"""Pairs and forms against all pairs of words, and the query against plain Python."""

import random
import re
import zlib
from collections import Counter

from gaugeline.llm import spelling
from tests.llm.conftest import frame


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return rows


def vocabulary(seed, n, letters, longest=8):
    pick, out = random.Random(seed), set()
    while len(out) < n:
        w = "".join(pick.choice(letters) for _ in range(pick.randrange(1, longest)))
        for _ in range(pick.randrange(4)):
            out.add(w)
            i = pick.randrange(len(w) + 1)
            w = pick.choice([w[:i] + pick.choice(letters) + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + pick.choice(letters) + w[i:]]) or "a"
    return sorted(out)


def test_pairs_once_and_all(spark):
    for seed, letters in ((1, "ab"), (2, "abcé"), (3, "abcdefghijklmnopqrstuvwxyzàÿ")):
        words = vocabulary(seed, 400, letters, 10 if len(letters) < 5 else 7)
        found = spelling.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
        pairs = [tuple(sorted(map(str, (r.a, r.b)))) for r in found]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}


def test_forms_and_roots(spark):
    pick = random.Random(4)
    counts = {w: 2 ** pick.randrange(0, 12) + pick.randrange(2) for w in vocabulary(5, 300, "abc")}
    counts |= {"x" * k: 3 ** (20 - k) for k in range(1, 20)}  # one long chain
    rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in rows} == brute(counts) and len(rows) == len(counts)


def counted(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                h %= len(w)
                w = w[:h] + w[h + 1 :]
            if len(w) >= 5:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 3}


def test_query_against_brute_force(spark, tables, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    pick = random.Random(7)
    known = [w for w in vocabulary(6, 200, "abcdÉé÷", 9) if len(w) > 3]
    texts = [" ".join(known[int(len(known) * pick.random() ** 3)].title() + pick.choice(["", ",", "-x", "Āy", "1"]) for _ in range(120)) for _ in range(60)]
    texts += [None, "", "ABCDEİFG straße ﬁnde", texts[0], texts[1]]
    ids = [*range(len(texts) - 2), None, 1]
    path = tables(documents=frame(spark, texts, ids))
    want = brute(counted(list(zip(ids, texts))))
    rows = spelling.op11_spelling(spark, path).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) > 100
    assert any(r.form for r in rows)


def test_odd_rows_and_empty(spark, odd, empty):
    assert {r.word for r in spelling.word_counts(odd, least=1).collect()} >= {"three", "x" * 50_000}
    assert spelling.variants(spelling.word_counts(empty)).count() == 0


def test_very_long_words(spark):
    long = "ab" * 20_000
    more, less, other = long[:500] + "c" + long[500:], long[:-1], "c" + long[1:]
    counts = {long: 9, more: 4, less: 2, other: 1}
    rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {(r.word, r.form, r.n_near) for r in rows} == {(long, None, 3), (more, long, 1), (less, long, 1), (other, long, 1)}
