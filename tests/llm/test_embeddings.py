"""The join against all cosines, on clusters, copies and odd vectors."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, dims int, node long, block string, id string, n_links int"


def brute(rows, cosine=embeddings.COSINE):
    """rows (id, vector, label) to a Counter of (id, n_links, component, kept)."""
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if k else None for r, k in zip(rows, ok)]
    n = len(rows)
    near = [[j for j in range(n) if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out = Counter()
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        out[(rows[i][0], len(near[i]), c, rows[i][0] == c)] += 1
    return out


def clustered(seed, n, dims, labels=3, spread=0.05):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(n // 6 + 1, dims))
    x = centres[pick.integers(len(centres), size=n)] + pick.normal(size=(n, dims)) * spread * pick.integers(1, 9, size=(n, 1))
    return [(int(i), [float(np.float32(c)) for c in v], int(pick.integers(labels))) for i, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], SCHEMA)


def found(df):
    return Counter(map(tuple, embeddings.near_copies(df).select("id", "n_links", "component_id", "kept").collect()))


@pytest.mark.parametrize("tile,leaf", [(1024, 16), (16, 4)])
def test_links_against_all_cosines(spark, monkeypatch, tile, leaf):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "LEAF", leaf)
    rows = clustered(1, 500, 24)
    rows += [(1000 + i, rows[i % 3][1], rows[i % 3][2]) for i in range(60)]  # copies
    assert found(frame(spark, rows)) == brute(rows)


def test_every_pair_in_one_block(monkeypatch):
    """Each pair within the bound counts in exactly one block, and in the boxes that one of both reaches."""
    pick = np.random.default_rng(5)
    x = embeddings.unit(pick.normal(size=(300, 16)))
    near = embeddings.unit(x + pick.normal(size=x.shape) * pick.uniform(0.01, 0.15, size=(300, 1)))
    monkeypatch.setattr(embeddings, "LEAF", 4)
    model = embeddings.Blocks(np.concatenate([x, near]))
    cosine = np.einsum("ij,ij->i", x, near)
    times = np.zeros(300, int)
    for b, (tree, part) in enumerate(zip(model.trees, model.parts)):
        pairs = model.near(b, x, near)
        for i, k in pairs.tolist():
            if i == k:
                times[i] += 1
                depth = len(tree.axis)
                row, leaf = tree.reached(model.turned(x[i : i + 1])[:, part], depth, model.budget[b])
                assert tree.home(model.turned(near[i : i + 1])[:, part], depth)[0] in leaf
    assert (times == (cosine >= embeddings.COSINE)).all() and 50 < times.sum() < 300


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.1], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1),
        (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [3e38, 0.0], 1), (12, [1e-30, 0.0], 1), (13, [-1.0, 0.0], 1),
        (14, [1.0], 1), (15, [2.0], 1), (None, [0.0, 1.0], 7), (16, [-0.0, 5.0], 8), (17, [0.0, 5.0], 8),
    ]
    assert found(frame(spark, rows)) == brute(rows)


def test_empty_and_all_odd(spark):
    assert found(frame(spark, [])) == Counter()
    rows = [(1, None, 1), (2, [0.0], 2)]
    assert found(frame(spark, rows)) == brute(rows)


def test_query_and_its_sql(spark, tables):
    import duckdb

    rows = clustered(8, 400, 8, labels=4, spread=0.08)
    path = tables(embeddings=frame(spark, rows).select("vec_id", "embedding", "label", F.lit(1).alias("kept")))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    cols = ["vec_id", "n_links", "component_id", "kept"]
    want = Counter(con.execute(f"SELECT {', '.join(cols)} FROM ({embeddings.OP12_SQL})").fetchall())
    assert Counter(map(tuple, embeddings.op12_embeddings(spark, path).select(*cols).collect())) == want == brute(rows)
