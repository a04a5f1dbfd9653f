import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from gaugeline.llm import quality, toxicity

from .conftest import ODD, frame, words


def corpus(n=400):
    pick = random.Random(9)
    texts, toxic, good = [], [], []
    for i in range(n):
        w = words(i % 57, 60) + words(1000 + i, 40)
        pick.shuffle(w)
        bad, junk = i % 5 == 0, i % 4 == 1
        if bad:
            for _ in range(4):
                w.insert(pick.randrange(len(w)), pick.choice(["awfulword", "nastyword", "vileword"]))
        text = ". ".join(" ".join(w[k : k + 10]).capitalize() for k in range(0, len(w), 10)) + "."
        if junk:
            text = text.upper().replace(" ", "!! ") if i % 8 == 1 else " ".join(x + "***" for x in text.split())
        texts.append(text)
        toxic.append(int(bad))
        good.append(int(not junk))
    return texts, toxic, good


def labels(spark, quality_, toxic):
    return spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(zip(quality_, toxic))], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_folds(spark, tables):
    texts, toxic, good = corpus()
    d = tables(documents=frame(spark, texts), labels=labels(spark, good, toxic))
    for query, truth, by, out in ((toxicity.op4_toxicity, toxic, 5, 0), (quality.op7_quality, good, 3, 1)):
        rows = {r["doc_id"]: r for r in query(spark, d).collect()}
        assert len(rows) == len(texts)
        assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % by == out) for i in rows)
        held = [i for i in rows if rows[i]["held_out"]]
        assert np.mean([rows[i]["predicted"] == truth[i] for i in held]) > 0.95
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())


def test_held_out_labels_are_not_learnt(spark, tmp_path):
    texts, toxic, good = corpus(150)
    flipped_t = [1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t for i, t in enumerate(toxic)]
    flipped_q = [1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q for i, q in enumerate(good)]
    for name, q, t in (("a", good, toxic), ("b", flipped_q, flipped_t)):
        frame(spark, texts).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels(spark, q, t).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    for query in (toxicity.op4_toxicity, quality.op7_quality):
        a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in query(spark, f"{tmp_path}/{n}").collect()) for n in "ab")
        assert a == b


def test_odd_rows_and_no_labels(spark, odd, empty, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    none.write.parquet(f"{tmp_path}/odd/labels.parquet")
    empty.write.parquet(f"{tmp_path}/empty/documents.parquet")
    none.write.parquet(f"{tmp_path}/empty/labels.parquet")
    for query in (toxicity.op4_toxicity, quality.op7_quality):
        rows = query(spark, f"{tmp_path}/odd").collect()
        assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
        assert query(spark, f"{tmp_path}/empty").count() == 0
    assert {r["score"] for r in quality.op7_quality(spark, f"{tmp_path}/odd").collect()} == {0.5}
    scored = quality.score(odd, quality.Voters([], np.zeros(0)), name="__score")  # a column of that name is replaced
    assert sorted(scored.columns) == sorted(odd.columns) and {r["__score"] for r in scored.collect()} == {0.5}


def kneser_ney(texts, labels, everything, discount):
    """The two models by dictionaries and loops: p(class, before, word)."""
    split = [t.split() for t in texts]
    word, pair = [Counter(), Counter()], [Counter(), Counter()]
    for t, c in zip(split, labels):
        word[c].update(set(t))
        pair[c].update(set(zip(["<s>", *t], t)))
    before = Counter(w for _, w in {*pair[0], *pair[1]})
    corpus = Counter(w for t in everything for w in t.split())
    kinds, left = sum(before.values()), sum(min(n, toxicity.SHARED_DISCOUNT) for n in before.values())

    def shared(w):
        return max(before[w] - toxicity.SHARED_DISCOUNT, 0) / kinds + left / kinds * corpus[w] / sum(corpus.values())

    def p(c, v, w):
        total = sum(word[c].values())
        rest = sum(min(n, discount) for n in word[c].values()) / total
        alone = max(word[c][w] - discount, 0) / total + rest * shared(w)
        held = sum(n for (x, _), n in pair[c].items() if x == v)
        if not held:
            return alone
        rest = sum(min(n, discount) for (x, _), n in pair[c].items() if x == v) / held
        return max(pair[c][v, w] - discount, 0) / held + rest * alone

    return p


def test_models_equal_brute_force_and_sum_to_one(spark):
    pick, names = random.Random(3), "abcdefgh"
    texts = [" ".join(pick.choice(names) for _ in range(pick.randrange(1, 12))) for _ in range(60)]
    labels_ = [i % 3 == 0 and 1 or 0 for i in range(60)]
    others = [" ".join(pick.choice(names) for _ in range(9)) for _ in range(20)]
    rows = spark.createDataFrame(list(zip(texts, labels_)), "text string, label int")
    model = toxicity.fit(spark.createDataFrame([(t,) for t in texts + others], "text string"), rows)
    p = kneser_ney(texts, labels_, texts + others, toxicity.DISCOUNT)
    for text in (*others, "a", "a a b"):
        ((_, words_, first),) = toxicity._tokens(pa.array([text]))
        got, split = np.exp(model.log_likelihoods(words_, first)), text.split()
        for i, (v, w) in enumerate(zip(["<s>", *split], split)):
            assert all(abs(got[c, i] - p(c, v, w)) < 1e-9 for c in (0, 1))
    for v in ["<s>", *names]:
        assert all(abs(sum(p(c, v, w) for w in names) - 1) < 1e-9 for c in (0, 1))
    best = max(np.mean(np.log([p(1, *x) / p(0, *x) for x in zip(["<s>", *others[0].split()], others[0].split())][k : k + toxicity.RUN])) for k in range(9 - toxicity.RUN + 1))
    assert abs(model.evidence(pa.array([others[0]]))[0] - best) < 1e-9


def sparse(texts):
    return [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in quality.counts(pa.array(texts))]


def test_votes_equal_a_dense_reference():
    """The same projection by a dense singular value decomposition, and votes by a sort."""
    texts, _, good = corpus(60)
    good = np.array(good)
    model = quality.Voters(sparse(texts), good)
    terms = quality.counts(pa.array(texts)).astype(float)
    terms /= np.linalg.norm(terms, axis=1, keepdims=True)
    scale = np.minimum(1 / np.sqrt((terms**2).mean(0) + 1e-6), 40)
    axes = np.linalg.svd(terms * scale, full_matrices=False)[2][: quality.RANK].T
    vectors = (terms * scale) @ axes
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    got = model.scores(pa.array(texts))
    near = vectors @ vectors.T
    for i in range(len(texts)):
        best = np.argsort(-near[i])[: quality.NEAREST]
        weight = np.maximum(near[i][best], 1e-3) ** quality.POWER
        assert abs((weight * good[best]).sum() / weight.sum() - got[i]) < 0.02


def test_empty_texts_are_voted_on():
    texts, _, good = corpus(60)
    model = quality.Voters(sparse([*texts, "", "", ""]), np.array([*good, 0, 0, 0]))
    empty, full = model.scores(pa.array([None, texts[0]]))
    assert empty < full


def test_inflected_words_of_no_labelled_text_are_told(spark):
    """Every toxic text has forms of its own; only their beginning comes again."""
    pick, suffix = random.Random(5), iter(words(77, 4000))
    texts, toxic = [], []
    for i in range(300):
        w = words(i % 57, 60) + words(1000 + i, 40)
        if i % 5 == 0:
            for _ in range(2):
                w.insert(pick.randrange(len(w)), "zuvél" + next(suffix) + str(i))
        texts.append(" ".join(w))
        toxic.append(int(i % 5 == 0))
    rows = {r["id"]: r for r in toxicity.score(frame(spark, texts), labels(spark, [1] * 300, toxic).select("doc_id", "toxic").withColumnRenamed("toxic", "label")).collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {rows[i]["score"] >= 0.5 for i in held if toxic[i]} == {True}
    assert np.mean([rows[i]["score"] >= 0.5 for i in held if not toxic[i]]) < 0.05


def test_expressions_count_letters_and_leave_a_text_out():
    ((_, words_, _, stems, of),) = toxicity._spelled(pa.array(["ßßßßé abcde abcd"]))
    assert len(words_) == 3 and of.tolist() == [0, 1]
    counts = np.array([[1.0, 0.0], [5.0, 9.0]])
    found = toxicity.Expressions(np.array([7, 9], np.uint64), counts, np.array([10, 10]))
    keys = np.array([7, 9, 8], np.uint64)
    ratio = lambda a, b: np.log((max(a - 3, 0) + 1.5) / (max(b - 3, 0) + 1.5))
    assert np.allclose(found.evidence(3, np.arange(3), keys), [ratio(5, 1), ratio(9, 0), 0])
    assert np.allclose(found.evidence(3, np.arange(3), keys, np.array([1, 1, 1])), [ratio(4, 1), ratio(8, 0), 0])
