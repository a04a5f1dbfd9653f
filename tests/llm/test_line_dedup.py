import random
import re

import pytest

from gaugeline.llm import line_dedup as ld

from .conftest import ODD, frame, words


def brute(texts):
    seen, gone = [], {}
    for i, text in enumerate(texts):
        gone[i] = []
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", line.lower()) if w)
            if not s:
                continue
            if any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                gone[i].append(k)
            seen.append(s)
    return gone


def corpus():
    pick, base = random.Random(2), [words(i, pick_n) for i, pick_n in enumerate([3, 4, 5, 8, 12, 30, 60, 120, 300])]
    texts = []
    for i in range(60):
        lines = []
        for w in pick.sample(base, 4):
            w = list(w)
            for _ in range(pick.randrange(0, 1 + len(w) // 6)):
                w[pick.randrange(len(w))] = f"n{pick.randrange(40)}"
            pick.shuffle(w)
            lines.append(" ".join(w).capitalize() + ".")
        texts.append("\n".join([*lines, "", "  "]))
    return texts


def test_against_brute_force(spark, tables):
    texts = [*ODD, *corpus()]
    want = brute(texts)
    got = {r["doc_id"]: r for r in ld.op8_line_dedup(spark, tables(documents=frame(spark, texts))).collect()}
    assert {i: r["removed"] for i, r in got.items()} == want
    assert all(r["n_lines"] == len((texts[i] or "").split("\n")) for i, r in got.items())
    clean = {r["doc_id"]: r["text"] for r in ld.drop_later_lines(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        kept = "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in want[i])
        assert (clean[i] or "") == kept


def test_a_second_round_finds_what_the_nearest_do_not(spark, monkeypatch):
    monkeypatch.setattr(ld, "NEAREST", 1)
    texts = corpus()
    found = {r["id"]: r["gone"] for r in ld.later_matches(frame(spark, texts)).collect()}
    assert found == {i: g for i, g in brute(texts).items() if g}


def test_repeated_rows_and_empty(spark, odd, empty):
    out = ld.drop_later_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert ld.drop_later_lines(empty).count() == 0
    twice = frame(spark, ["same line of five words", "same line of five words", None], [1, 1, None])
    assert sorted(r["text"] or "" for r in ld.drop_later_lines(twice).collect()) == ["", "same line of five words", "same line of five words"]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_out_of_order(spark, monkeypatch, kind):
    monkeypatch.setattr(ld, "NEAREST", 1)
    texts, pick = corpus(), random.Random(4)
    name = (lambda i: i) if kind == "long" else (lambda i: f"document {i:03d}")  # alike in their first bytes
    rows = [(name(i), t) for i, t in enumerate(texts)]
    pick.shuffle(rows)
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)
    found = {r["id"]: r["gone"] for r in ld.later_matches(docs).collect()}
    assert found == {name(i): g for i, g in brute(texts).items() if g}


def test_hashes_of_texts_travel_only_where_ids_are_tied(spark):
    import numpy as np

    def sent(texts, ids):
        docs = frame(spark, texts, ids).select("doc_id", "text").selectExpr("doc_id as id", "xxhash64(coalesce(text, '')) as th", "text")
        lines = ld.line_sets(docs, np.full(ld.BUCKETS, 2, np.uint16), "bigint")
        firsts = lines.groupBy("a", "b").agg(*[ld.F.max(c).alias(c) for c in ("n", "bits", "wide", "keys")], ld.F.min(ld.F.struct("id", "th", "line")).alias("first"))
        tied = ld.tied(lines)
        got = [np.frombuffer(bytes(r["rows"]), ld._ROW) for r in ld.prefixes(firsts, with_texts=tied).collect()]
        return tied, {int(x) for r in got for x in r["th"]}, sum(map(len, got))

    plain, other = "one two three four five six", "seven eight nine ten eleven"
    tied, hashes, n = sent([plain, other], [1, 2])
    assert not tied and hashes == {0} and n > 2
    for ids in ([1, 1], [1, None]):
        tied, hashes, _ = sent([plain, other], ids)
        assert tied and 0 not in hashes and len(hashes) == 2
