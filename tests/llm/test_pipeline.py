import re

import pyarrow as pa

import corpus_pipeline
from gaugeline.llm import pieces
from gaugeline.session import table

from .conftest import frame, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_each_other(spark, tables):
    texts, good = [], []
    for i in range(120):
        w = words(i, 80)
        text = ". ".join(" ".join(w[k : k + 8]).capitalize() for k in range(0, 80, 8)) + "."
        if i % 6 == 5:
            text = text.upper().replace(" ", "!! ")
        good.append(int(i % 6 != 5))
        texts.append(text)
    texts += [texts[0], texts[1].replace(" ", "  "), " ".join(texts[2].split()[:-2] + ["new", "end."])]
    docs = frame(spark, texts).select(*COLUMNS)
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(good)], "doc_id long, quality int, toxic int")
    d = tables(documents=docs, labels=labels)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now, kept = table(spark, d, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, d)
        rows = now.collect()
        kept.append(rows)
        assert now.columns == (COLUMNS if k < 4 else [*COLUMNS, "ids"])
        now = spark.createDataFrame(rows, now.schema)
    assert {r["doc_id"] for r in kept[0]} == {i for i in range(120) if good[i]} | {120, 121, 122}
    assert {r["doc_id"] for r in kept[1]} == {i for i in range(120) if good[i]} | {122}
    assert {r["doc_id"] for r in kept[2]} == {i for i in range(120) if good[i]}
    assert {r["doc_id"] for r in kept[3]} <= {r["doc_id"] for r in kept[2]} and kept[3]
    assert len(kept[4]) == len(kept[3])
    assert pieces.codec().decode(pa.array([r["ids"] for r in kept[4]], pa.list_(pa.int32()))) == [r["text"] for r in kept[4]]
    assert corpus_pipeline.run(spark, d).count() == len(kept[4])


def test_each_stage_on_odd_rows(spark, odd, empty, tables):
    """Null, empty, very long, tied and repeated rows, columns with clashing names, an empty table: each stage against plain Python."""
    d = tables(documents=odd, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    had = odd.collect()
    rows = {name: None for name, _ in corpus_pipeline.STAGES}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, d)
        want = odd.columns if k < 4 else [*[c for c in odd.columns if c != "ids"], "ids"]
        assert out.columns == want
        rows[name] = out.collect()
        none = stage(spark, empty, d)
        assert none.columns == want and none.count() == 0
    assert len(rows["quality classifier"]) == len(had)  # without labels all stay
    first = {}
    for r in sorted(had, key=lambda r: (r["doc_id"] is None, r["doc_id"])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert sorted(map(str, first.values())) == sorted(str(r["doc_id"]) for r in rows["exact dedup"])
    words_of = lambda t: tuple(w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w)
    assert {words_of(r["text"]) for r in rows["near dedup"]} == {words_of(r["text"]) for r in had}
    assert len(rows["near dedup"]) == len({words_of(r["text"]) for r in had})
    assert all((r["doc_id"], r["text"]) in {(h["doc_id"], h["text"]) for h in had} for r in rows["mixing"])
    ids = pa.array([r["ids"] for r in rows["pieces"]], pa.list_(pa.int32()))
    assert sorted(pieces.codec().decode(ids)) == sorted(r["text"] or "" for r in had)
