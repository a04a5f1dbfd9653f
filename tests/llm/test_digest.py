import hashlib

from gaugeline.llm import digest as dg

from .conftest import ODD, frame, words


def test_bounds_and_round_trip():
    a, b = dg.digest(" ".join(words(1, 500)).encode()), dg.digest(" ".join(words(2, 500)).encode())
    assert dg.likeness(a, a) == 1.0 and 0 <= dg.likeness(a, b) < 1
    assert dg.likeness(a, b) == dg.likeness(b, a)
    assert dg.as_text(dg.from_text(dg.as_text(a))) == dg.as_text(a)
    assert dg.difference(dg.digest(b""), dg.digest(b"x" * 10**6)) <= dg.MOST


def brute(rows):
    """rows: (doc_id, text) with different ids."""
    rows = sorted(rows, key=lambda r: -r[0])
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        yield doc_id, hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest(), dg.likeness(dg.digest(text.encode()), dg.digest(after.encode()))


def test_query_against_brute_force(spark, tables):
    texts = [*ODD, *[" ".join(words(i, 30 + i)) for i in range(40)]]
    got = dg.op2_digest(spark, tables(documents=frame(spark, texts))).collect()
    want = {d: (h, n) for d, h, n in brute([(i, t or "") for i, t in enumerate(texts)])}
    assert {r["doc_id"]: (r["edited_sha256"], r["near_next"]) for r in got} == want
    same = {r["fingerprint"] for r in got if r["doc_id"] in (3, 4)}
    assert len(same) == 1
    assert all(r["near_edited"] >= r["near_next"] for r in got if r["doc_id"] >= len(ODD))


def test_one_row_repeated_ids_and_none(spark, empty, tables, tmp_path):
    one = frame(spark, ["abc"])
    one.write.parquet(f"{tmp_path}/one/documents.parquet")
    row = dg.op2_digest(spark, f"{tmp_path}/one").first()
    assert row["edited_sha256"] == hashlib.sha256(b"aba").hexdigest() and row["near_next"] == 1.0
    frame(spark, ["b", "a", "a", None], [1, 1, 1, None]).write.parquet(f"{tmp_path}/many/documents.parquet")
    assert dg.op2_digest(spark, f"{tmp_path}/many").count() == 4
    assert dg.op2_digest(spark, tables(documents=empty)).count() == 0
    assert dg.fingerprint(empty).count() == 0


def test_a_hot_id_is_cut_and_each_row_has_its_next(spark, tmp_path):
    texts = [" ".join(words(i, 5 + i % 7)) for i in range(400)]
    frame(spark, texts, [None if i % 4 else i // 40 for i in range(400)]).write.parquet(f"{tmp_path}/hot/documents.parquet")
    placed = dg.with_next(spark.read.parquet(f"{tmp_path}/hot/documents.parquet").select("doc_id", "text"))
    sizes = {r["block"]: r["count"] for r in placed.where("copy = 0").groupBy("block").count().collect()}
    assert sum(sizes.values()) == 400 and max(sizes.values()) < 40
    rows = sorted(placed.where("copy = 0").collect(), key=lambda r: (-r["key"], -r["tie"], r["text"]))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest() for t, u in zip([r["text"] for r in rows], [r["text"] for r in rows[1:] + rows[:1]]))
    assert sorted(r["edited_sha256"] for r in dg.op2_digest(spark, f"{tmp_path}/hot").collect()) == want


def plain(text):
    """The digest told again, byte by byte."""
    text = text.ljust(4, b"\0")
    counts = [0] * dg.BUCKETS
    for at in range(len(text) - 3):
        for i, places in enumerate(dg.TRIPLETS):
            a, b, c = (text[at + p] for p in places)
            head = int(dg._FIRST[i][a * 256 + b])
            counts[int(dg._SECOND[i][head * 256 + c])] += 1
    ranked = sorted(counts)
    quarters = [ranked[len(ranked) * q // 4 - 1] for q in (1, 2, 3)]
    return [sum(n > q for q in quarters) for n in counts]


def test_digest_against_counting_by_hand():
    for text in ("", "abc", "é😀 word", *[" ".join(words(i, 200)) for i in range(3)]):
        length, codes = dg.digest(text.encode())
        assert codes.tolist() == plain(text.encode())
        assert dg.as_text((length, codes))[:2] == f"{length:02x}"
    a, b = (plain(" ".join(words(i, 200)).encode()) for i in (1, 2))
    gap = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(a, b))
    la, lb = (dg.digest(" ".join(words(i, 200)).encode())[0] for i in (1, 2))
    assert dg.difference(dg.digest(" ".join(words(1, 200)).encode()), dg.digest(" ".join(words(2, 200)).encode())) == gap + min(64, 4 * abs(la - lb))
