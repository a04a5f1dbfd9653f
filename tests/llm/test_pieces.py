import pyarrow as pa
import pytest

from gaugeline.llm import pieces

from .conftest import ODD, frame

TEXTS = [t or "" for t in ODD] + ["Hello  world\n▁x é 漢字😀", "▁", "<0x41></s>", " a", "a ", "x" * 300 + "é" * 100, "naïve " * 40, "\u0000\u0001"]


def test_round_trip_and_whitespace():
    codec = pieces.codec()
    ids = codec.encode(pa.array(TEXTS))
    assert codec.decode(ids) == TEXTS
    assert codec.restores(ids, pa.array(TEXTS)).all()
    assert not codec.restores(ids, pa.array(["?" + t for t in TEXTS])).any()
    assert len(ids[0]) == 0


def test_scores_equal_the_librarys_unigram_model():
    library = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    codec, model = pieces.codec(), pb.ModelProto()
    with open(pieces.default_vocabulary(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if p.type in (1, 4):
            p.type, p.score = 1, codec.score[i]
    other = library.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [t for t in TEXTS if t and "▁" not in t and "\0" not in t]
    total = lambda ids: sum(codec.score[i] for i in ids if codec.score[i] > -1e9)
    for mine, text in zip(codec.encode(pa.array(texts)).to_pylist(), texts):
        theirs = other.encode(text)
        assert len(mine) == len(theirs) or abs(total(mine) - total(theirs)) < 1e-2
        assert abs(total(mine) - total(theirs)) < 1e-2


def test_long_and_short_segments_are_solved_alike():
    codec = pieces.codec()
    for text in ("internationalisation", "é漢a😀b", "aaaaaaaaaaaaaaa"):
        whole = codec.encode(pa.array([text])).to_pylist()[0]
        assert codec._solve_one((" " + text).encode()) == whole


def test_brute_force_segmentation():
    vocabulary = [(b" ", 0, -3.0), (b" a", 1, -1.5), (b"a", 2, -2.0), (b"ab", 3, -2.2), (b"b", 4, -2.1), (b"bb", 5, -3.0), (b"abb", 6, -4.5)]
    codec = pieces.Codec(vocabulary, list(range(7, 263)), 263)
    score = {p: s for p, _, s in vocabulary}

    def best(rest):
        if not rest:
            return 0.0
        return max((score[rest[:k]] + best(rest[k:]) for k in range(1, 4) if rest[:k] in score), default=-1e9)

    for text in ("abba", "bab", "abbb", "aabb", "bbbb"):
        ids = codec.encode(pa.array([text])).to_pylist()[0]
        assert abs(sum(codec.score[i] for i in ids) - best((" " + text).encode())) < 1e-9


def test_odd_rows(spark, odd, empty, tables):
    out = pieces.encode(odd, check="exact")
    assert out.columns == [*[c for c in odd.columns if c != "ids"], "ids", "exact"]  # a column of that name is replaced
    assert all(r["exact"] for r in out.collect())
    back = pieces.decode(out.select("doc_id", "text", "ids"))
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())
    assert pieces.encode(empty).count() == 0
    rows = pieces.op5_pieces(spark, tables(documents=frame(spark, TEXTS))).collect()
    assert all(r["exact"] and r["n_ids"] == len(r["ids"]) for r in rows) and len(rows) == len(TEXTS)
