import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import near_dedup as nd

from .conftest import CLASHES, ODD, frame, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def changed(pick, a, n):
    b = list(a)
    for _ in range(n):
        at = pick.randrange(len(b) + 1)
        kind = pick.randrange(3)
        if kind == 0:
            b.insert(at, pick.randrange(5))
        elif b and at < len(b):
            if kind == 1:
                b.pop(at)
            else:
                b[at] = pick.randrange(5)
    return b


def test_edits_equal_brute_force():
    pick = random.Random(3)
    for _ in range(300):
        a = [pick.randrange(5) for _ in range(pick.randrange(25))]
        b = changed(pick, a, pick.randrange(8))
        most = pick.randrange(12)
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        assert nd.edits(x, y, most) == min(distance(a, b), most + 1)
        if len(a) and len(b):
            short, long = sorted((x, y), key=len)
            if len(long) - len(short) <= most:
                for way in (nd._reaching, nd._banded):
                    assert min(way(short, long, most), most + 1) == min(distance(a, b), most + 1)


def test_equal_words_are_one_node_and_order_matters():
    texts = pa.array(["One two, three!", "one TWO three", "three two one", ""])
    (_, _, w, first), = nd._words(texts)
    a, b = nd.nodes(w, first)
    assert (a[0], b[0]) == (a[1], b[1]) != (a[2], b[2])
    assert (nd.sketch(w[:3]) == nd.sketch(w[3:6])).all()


def test_near_copies_share_a_class(spark):
    base, other = words(1, 200), words(2, 200)
    near = [*base[:90], "new", *base[92:150], "more", *base[150:]]
    far = [*base[:60], *other[60:]]
    docs = frame(spark, [" ".join(x) for x in (base, near, other, far, base)])
    found = {r["id"]: r for r in nd.classes(docs).collect()}
    assert found[0]["class_id"] == found[1]["class_id"] == found[4]["class_id"] == 0
    assert found[2]["class_id"] == 2 and found[3]["class_id"] == 3
    assert [found[i]["kept"] for i in range(5)] == [True, False, True, True, False]
    assert found[0]["class_size"] == 3


def test_odd_rows(odd, empty):
    found = nd.classes(odd).collect()
    assert len(found) == len(ODD) + 2
    by = {}
    for r in found:
        by.setdefault((r["a"], r["b"]), []).append(r)
    for rows in by.values():
        assert sum(r["kept"] for r in rows) <= 1
    assert sum(r["kept"] for r in found) == len({r["class_id"] for r in found})
    assert nd.drop_near_copies(odd).columns == odd.columns
    assert nd.drop_near_copies(odd).count() == sum(r["kept"] for r in found)
    assert nd.classes(empty).count() == nd.drop_near_copies(empty).count() == 0


def test_a_large_group_makes_few_pairs(spark):
    pick, base = random.Random(5), words(7, 60)
    texts = []
    for i in range(200):
        w = list(base)
        w[pick.randrange(60)] = f"word{i}"
        texts.append(" ".join(w))
    docs = frame(spark, texts)
    known = nd.sketches(docs, "doc_id", "text").selectExpr("id node", "n", "keys", "bits")
    assert nd.candidates(*nd.shared(known)).count() < 200
    assert {r["class_id"] for r in nd.classes(docs).collect()} == {0}


def test_a_repeated_id_with_other_words_is_another_document(spark):
    docs = frame(spark, [" ".join(words(i, 50)) for i in (1, 2, 2, 3)], [1, 1, 1, 2])
    kept = sorted(r["text"] for r in nd.drop_near_copies(docs).collect())
    assert kept == sorted(" ".join(words(i, 50)) for i in (1, 2, 3))


def star(seed, base, copies, least, most):
    """Copies of a text by substitutions scattered anew in each, so that they match the text and hardly each other."""
    pick, out = random.Random(seed), []
    for i in range(copies):
        w = list(base)
        for at in pick.sample(range(len(w)), round((1 - pick.uniform(least, most)) * len(w))):
            w[at] = f"new{i}x{at}"
        out.append(w)
    return out


def test_copies_of_a_text_that_are_not_alike_find_it(spark):
    base = words(11, 200)
    copies = [w for w in star(12, base, 1000, 0.82, 0.88) if nd.near(*(np.array([hash(x) & 0xFFFFFFFF for x in y], np.uint32) for y in (base, w)))]
    found = nd.classes(frame(spark, [" ".join(w) for w in (base, *copies)])).collect()
    sizes = {r["class_id"]: r["class_size"] for r in found}
    assert len(copies) == 1000 and sizes[0] >= 980  # the rest shares no key with the text


def test_no_pair_under_a_key_is_left_untried(spark):
    base = words(21, 120)
    texts = [" ".join(w) for w in (base, *star(22, base, 60, 0.82, 0.9), *([*words(i, 25), *base[:95]] for i in range(60)))]
    docs = frame(spark, texts)
    split = {t: np.array([hash(x) & 0xFFFFFFFF for x in t.split()], np.uint32) for t in texts}
    rows = nd.sketches(docs, "doc_id", "text").selectExpr("id", "id as node", "n", "keys", "bits")
    keys = {}
    for r in nd.shared(rows)[0].collect():
        keys.setdefault(r["key"], set()).add(r["node"])
    above = {i: i for i in range(len(texts))}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for nodes in keys.values():
        for i in nodes:
            for k in nodes:
                if i < k and top(i) != top(k) and nd.near(split[texts[i]], split[texts[k]]):
                    above[max(top(i), top(k))] = min(top(i), top(k))
    assert {r["id"]: r["class_id"] for r in nd.classes(docs).collect()} == {i: top(i) for i in above}


def pair(rng, n, similarity, inserted):
    """A text and a copy with scattered substitutions, or insertions, down to a similarity."""
    a = rng.integers(1, 2**63, n, dtype=np.uint64)
    if inserted:
        more = int(n / similarity + 1e-9) - n
        return a, np.insert(a, np.sort(rng.choice(n + 1, more)), rng.integers(1, 2**63, more, dtype=np.uint64))
    b, at = a.copy(), rng.choice(n, int((1 - similarity) * n + 1e-9), replace=False)
    b[at] = rng.integers(1, 2**63, len(at), dtype=np.uint64)
    return a, b


@pytest.mark.parametrize("inserted", [False, True])
def test_pairs_share_a_key_nine_times_in_ten_at_every_length(inserted):
    rng, keys = np.random.default_rng(1), lambda w: set(nd.sketch(w).tolist())
    for n in (5, 6, 8, 10, 11, 12, 13, 15, 20, 30, 40, 49, 50, 51, 55, 60, 63, 64, 70, 80, 100, 200, 400):
        for similarity in (0.8, 0.85, 0.9):
            pairs = [pair(rng, n, similarity, inserted) for _ in range(120)]
            assert sum(bool(keys(a) & keys(b)) for a, b in pairs) >= 108, (n, similarity)


def brute_classes(texts):
    """Classes by all pairs of different texts."""
    split = [np.array([hash(x) & 0xFFFFFFFF for x in t.lower().split()], np.uint64) for t in texts]
    above = list(range(len(texts)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(texts)):
        for k in range(i):
            if top(i) != top(k) and (texts[i] == texts[k] or len(split[i]) and len(split[k]) and nd.near(split[i], split[k])):
                above[max(top(i), top(k))] = min(top(i), top(k))
    return {i: top(i) for i in range(len(texts))}


def test_classes_equal_brute_force(spark):
    pick, texts = random.Random(31), []
    for seed in range(60):
        base = words(1000 + seed, pick.choice((1, 3, 5, 7, 10, 14, 20, 30, 45, 60, 90)))
        texts.append(base)
        for copy in range(pick.randrange(4)):
            w = list(base)
            for at in pick.sample(range(len(w)), pick.randrange(0, max(1, len(w) // 8 + 1))):
                w[at] = f"new{copy}x{at}"
            texts.append(w)
    line = words(5, 12)
    texts += [[*line, *words(2000 + i, 8)] for i in range(40)]  # one line in unlike texts
    texts = [" ".join(w) for w in texts]
    pick.shuffle(texts)
    found = {r["id"]: r["class_id"] for r in nd.classes(frame(spark, texts)).collect()}
    brute = brute_classes(texts)
    wrong = [i for i in brute if found[i] != brute[i]]
    assert len(wrong) <= 0.02 * len(texts)
    assert all(brute[i] == brute[found[i]] for i in found)  # what is joined belongs together


def test_tiles_leave_no_pair_out(spark, monkeypatch):
    """Many blocks of a key: every pair of different components that can match is met once."""
    monkeypatch.setattr(nd, "TILE", 4)
    rows = spark.createDataFrame([(key, i, 10, i, i % 3, 8) for key in (1, 2) for i in range(23)], "key long, node long, n int, score long, component long, members long")
    about = spark.createDataFrame([(i, 10, i, [0] * nd.NARROW) for i in range(23)], "node long, n int, score long, bits array<long>")
    found = {(r["x"], r["y"]) for r in nd.in_tiles(rows, about).collect()}
    assert found == {(i, k) for i in range(23) for k in range(i) if i % 3 != k % 3}


def test_big_classes_meet_whole(spark, monkeypatch):
    """Of two big classes and a lone node, every pair across them that can match is met once; at first the nearest of each block."""
    monkeypatch.setattr(nd, "BLOCK", 3)
    monkeypatch.setattr(nd, "BIG", 5)
    of = {**dict.fromkeys(range(10), 0), **dict.fromkeys(range(10, 20), 10), 20: 20}
    rows = [(key, i, 10, i, of[i], 10 if i < 20 else 1) for key in (1, 2) for i in range(21) if i % 4 == 0]  # not all members have the key
    rows = spark.createDataFrame(rows, "key long, node long, n int, score long, component long, members long")
    about = spark.createDataFrame([(i, 10, i, [0] * nd.NARROW) for i in range(21)], "node long, n int, score long, bits array<long>")
    components = spark.createDataFrame([(i, of[i]) for i in range(20)], "node long, component long")
    found = {(r["x"], r["y"]) for r in nd.with_classes(rows, components, about, None).collect()}
    assert found == {(20, i) for i in range(20)} | {(i, k) for i in range(10, 20) if i % 4 == 0 for k in range(10)}
    few = {(r["x"], r["y"]) for r in nd.with_classes(rows, components, about, 1).collect()}
    assert few < found and {x for x, _ in few} == {x for x, _ in found}


@pytest.mark.parametrize("inserted", [False, True])
def test_parities_never_exclude_a_match(spark, inserted):
    """Lengths around the edges of the widths, with words that repeat: folded or not, the bitmaps leave every match possible."""
    rng, rows, pairs = np.random.default_rng(4), [], []
    for n in (5, 25, 32, 33, 60, 64, 65, 120, 128, 129, 500, 512, 513, 600, 2000):
        a, b = (np.where(x % 3 == 0, x % 7, x).astype(np.uint64) for x in pair(rng, n, 0.8, inserted))
        assert nd.near(a, b)
        for w in (a, b):
            rows.append((len(rows), len(w), len(rows), nd.parity(w).tolist()))
        pairs.append((len(rows) - 2, len(rows) - 1))
    about = spark.createDataFrame(rows, "node long, n int, score long, bits array<long>")
    assert nd.possible(spark.createDataFrame(pairs, "x long, y long"), about).count() == len(pairs)
    keyed = spark.createDataFrame([(k, i, rows[i][1], i, i, 1) for k, p in enumerate(pairs) for i in p], "key long, node long, n int, score long, component long, members long")
    assert {(r["y"], r["x"]) for r in nd.in_tiles(keyed, about).collect()} == set(pairs)


def test_documents_of_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", 5), (1, "a b c d e f", 5), (1, "other words stand in this one", 6), (2, "a b c d e f", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").withColumns({c: F.lit(1) for c in CLASHES})
    kept = nd.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["row"]) for r in kept.collect()) == sorted({rows[0], rows[2]})


def test_texts_under_a_common_passage_are_dealt_into_tiles_once(spark, monkeypatch):
    common = words(4, 30)
    texts = [" ".join(common + words(100 + i, 60)) for i in range(12)]
    texts += [f"{texts[i]} more" for i in range(4)]
    dealt, tiles = [], nd.in_tiles
    monkeypatch.setattr(nd, "in_tiles", lambda rows, about: dealt.append(1) or tiles(rows, about))
    found = {r["id"]: r["class_id"] for r in nd.classes(frame(spark, texts)).collect()}
    assert found == {i: i % 12 if i >= 12 else i for i in range(16)}
    assert len(dealt) == 1
