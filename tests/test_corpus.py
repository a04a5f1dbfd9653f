import hashlib
import itertools
import random

from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators import classify
from gaugeline.operators import corpus as C
from gaugeline.operators import evaluate as E
from gaugeline.operators.graph import connected_components
from gaugeline.operators.joins import join_hot
from gaugeline.operators.store import Library, insert_if_absent, latest


def test_components_of_chains_and_stars(spark):
    pick = random.Random(1)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("h", f"s{i}") for i in range(150)] + [("x", "x"), ("y", None)]
    pick.shuffle(edges)
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a string, b string")).collect()))
    assert {found[f"c{i:03d}"] for i in range(61)} == {"c000"} and {found[f"s{i}"] for i in range(150)} == {"h"}
    assert "x" not in found and connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_groups_do_not_depend_on_order(spark):
    rows = [("1", "e1", "t1"), ("2", "e1", "t2"), ("3", "e3", "t2"), ("4", "e4", ""), ("5", "e5", None)]
    for some in list(itertools.permutations(rows))[:3]:
        got = dict(map(tuple, C.groups(spark.createDataFrame(some, "record_id string, event string, text string"), ["event", "text"]).collect()))
        assert got == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "5"}


def test_largest_remainder_and_near_equal(spark):
    strata = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 1, 2)], "label string, year int, n long")
    got = {(r["label"], r["year"]): r["quota"] for r in C.largest_remainder(strata, 7, ["label", "year"]).collect()}
    assert got == {("a", 1): 4, ("a", 2): 2, ("b", 1): 1} and sum(got.values()) == 7
    labels = spark.createDataFrame([("d", "x"), ("d", "y"), ("d", "z")], "domain string, label string")
    assert {r["label"]: r["quota"] for r in C.near_equal(labels, 8, "domain", "label").collect()} == {"x": 3, "y": 3, "z": 2}


def test_unit_hash_and_median(spark):
    score = spark.range(1).select(T.unit_hash(F.lit("seed:1")).alias("s")).first()["s"]
    assert score == int(hashlib.sha256(b"seed:1").hexdigest()[:8], 16) / 2**32
    rows = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)], "g string, v int")
    assert C.upper_median(rows, "v", "g").first()["median"] == 3


def test_jaccard_pairs_against_brute_force(spark):
    pick = random.Random(2)
    texts = []
    for i in range(60):
        w = [chr(97 + (i % 5)) * 3 + chr(97 + k) for k in range(20)]
        for _ in range(pick.randrange(3)):
            w[pick.randrange(20)] = "zz" + chr(97 + pick.randrange(26))
        texts.append((str(i), " ".join(w)))
    sets = C.token_sets(spark.createDataFrame(texts, "record_id string, text string"), "text")
    got = {(r["a"], r["b"]) for r in C.jaccard_pairs(sets).collect()}
    known = {i: set(t.split()) for i, t in texts}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(known), 2) if len(known[a] & known[b]) >= 0.9 * len(known[a] | known[b])}


def test_partitions(spark):
    rows = spark.createDataFrame([("1", "g", "2020-01-01", "es"), ("2", "g", "2026-01-01", "en"), ("3", "h", "", "en"), ("4", "k", "2020-01-01", "en")], "record_id string, group_id string, date string, lang string")
    got = dict(map(tuple, C.temporal_partition(rows, "group_id", F.col("date"), "2021", "2022").collect()))
    assert got == {"g": "quarantine", "h": "quarantine", "k": "train"}
    held = dict(map(tuple, C.held_out_partition(rows, "group_id", F.col("lang"), ["es"], "s").collect()))
    assert held["g"] == "test" and {held["h"], held["k"]} <= {"train", "validation"}


def test_a_hot_key_joins_whole(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id")
    known = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    assert join_hot(rows, known, ["k"], "n", ["v"]).where("v = 2 * k").count() == 2000


def test_metrics(spark):
    span = "record_id string, start int, stop int, label string, assertion string"
    gold = spark.createDataFrame([("r", 0, 1, "A", "present"), ("r", 2, 3, "B", "negated"), ("r", 2, 3, "B", "negated")], span)
    predicted = spark.createDataFrame([("r", 0, 1, "A", "negated"), ("r", 5, 6, "B", "present")], span)
    row = E.metrics(predicted, gold, E.SPAN).first()
    assert (row["predicted"], row["reference"], row["correct"], row["precision"], row["recall"], row["f1"]) == (2, 2, 1, 0.5, 0.5, 0.5)
    none = E.metrics(gold.limit(0), gold.limit(0), E.SPAN).first()
    assert none["f1"] == 0 and none["predicted"] == 0
    assert [tuple(r) for r in E.confusion(gold, predicted).collect()] == [("present", "negated", 1)]
    report = E.class_report(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "actual string, predicted string"))
    assert {r["label"]: r["support"] for r in report.collect()} == {"a": 2, "b": 2, "c": 0}


def test_store_versions_and_reviews(spark, tmp_path):
    library = Library(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("r1", "p1"), ("r2", "p2")], "record_id string, payload string")
    assert library.save_run(rows, {"a": 1}).count() == 2 and library.save_run(rows, {"a": 1}).count() == 0
    run = library.records().where("record_id = 'r1'").first()["run_id"]
    library.save_reviews(spark.createDataFrame([(run, "r1", "fixed")], "run_id string, record_id string, payload string"))
    assert {r["record_id"]: r["payload"] for r in library.records().collect()} == {"r1": "fixed", "r2": "p2"}
    assert {r["payload"] for r in library.records(reviewed=False).collect()} == {"p1", "p2"}
    assert library.save_run(rows, {"a": 2}).count() == 2
    assert {r["payload"] for r in library.records().collect()} == {"p1", "p2"} and library.history().count() == 1
    try:
        library.save_reviews(spark.createDataFrame([("no", "r1", "x")], "run_id string, record_id string, payload string"))
        raise AssertionError
    except ValueError:
        pass
    library.backup(str(tmp_path / "copy"))
    assert Library(spark, str(tmp_path / "copy")).records().count() == 2


def test_latest_and_insert(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (3, "a", "y"), (2, "b", None)], "id long, key string, value string")
    assert {(r["key"], r["value"]) for r in latest(rows, ["key"], "id").collect()} == {("a", "y"), ("b", None)}
    assert [r["id"] for r in insert_if_absent(rows, rows.where("key = 'b'"), ["key"], "id").collect()] == [1]


def test_classifier_on_separable_text(spark):
    rows = spark.createDataFrame([(f"red apple fruit {i}", "fruit") for i in range(20)] + [(f"steel bolt metal {i}", "metal") for i in range(20)], "text string, label string")
    model = classify.train(rows, iterations=20)
    out = classify.predict(model, spark.createDataFrame([("an apple fruit",), ("a steel bolt",)], "text string")).collect()
    assert [r["predicted"] for r in out] == ["fruit", "metal"] and all(0.5 < r["confidence"] <= 1 for r in out)


def test_whole_queries_keep_documents_that_redaction_touches(spark, tmp_path):
    import hashlib

    import __spark_entry__ as entry

    texts = {1: "Plain  words here", 2: "Write to user1@example.com now", 3: None, 4: "room twelve", 5: "Seen 3 cracks"}
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], schema).write.parquet(f"{tmp_path}/documents.parquet")
    index = {r["record_id"]: r for r in entry.queries()["corpus_index"](spark, str(tmp_path)).collect()}
    said = {r["source_record_id"]: r for r in entry.queries()["source_dialect_rows"](spark, str(tmp_path)).collect()}
    assert set(index) == set(said) == {str(i) for i in texts}
    for i, t in texts.items():
        plain = " ".join((t or "").split())
        a, b = index[str(i)], said[str(i)]
        assert a["sensitive"] == b["sensitive"] == (i == 2)
        assert a["excluded"] == b["excluded"] == ("empty_narrative" if not plain else "")
        assert a["words"] == len(plain.split())
        if i == 2:
            assert "user1" not in b["narrative"]
        else:
            assert b["narrative"] == plain and a["exact"] == (hashlib.sha256(plain.lower().encode()).hexdigest() if plain else "")


def test_group_splits_do_not_leak(spark):
    rows = spark.createDataFrame([(str(i), f"g{i // 3}") for i in range(60)], "record_id string, group_id string")
    assert C.leaks(rows.withColumn("split", C.grouped_split(F.col("group_id"), "s"))).first()["leaking_groups"] == 0
    assert C.leaks(rows.withColumn("split", F.when(F.col("record_id").cast("int") % 3 == 0, "test").otherwise("train"))).first()["leaking_groups"] == 20


def test_jaccard_pairs_of_long_and_short_sets_and_few_verified(spark, monkeypatch):
    """Families of near copies: all their pairs are found; grouping compares a few of them, and ties what no first candidate ties."""
    import random

    rng = random.Random(3)
    names = [f"{a}{b}{c}" for a in "bcdfgk" for b in "aeiou" for c in "lmnprst"]
    sets = []
    for n in (8, 20, 60, 150):
        base = rng.sample(names, n)
        for k in range(12):
            spare = [w for w in names if w not in base]
            sets.append((f"{n:03d}-{k:02d}", sorted(base[: n - n // 20 * (k > 0)] + rng.sample(spare, n // 20 * (k > 0)))))
    chain = rng.sample(names, 40)
    sets += [(f"c{i}", sorted(chain[i * 2 : i * 2 + 30])) for i in range(5)]  # neighbours alone are near
    like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(a, b) for a, x in sets for b, y in sets if a < b and like(x, y) >= 0.8}
    rows = spark.createDataFrame(sets, "record_id string, words array<string>")
    assert {(r.a, r.b) for r in C.jaccard_pairs(rows, 0.8).collect()} == want
    asked, verified = [], C.jaccard_verified
    monkeypatch.setattr(C, "jaccard_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    found = {r.node: r.component for r in C.jaccard_groups(rows, spark.createDataFrame([("003", "c0")], "a string, b string"), 0.8).collect()}
    parent = {x: x for x, _ in [*sets, ("003", None)]}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in sorted(want | {("003", "c0")}):
        lo, hi = sorted((top(a), top(b)))
        parent[hi] = lo
    assert found == {x: top(x) for x in parent if any(x in p for p in want | {("003", "c0")})}
    assert sum(asked) < len(want) / 2


def test_partition_shuffles_no_text(spark):
    """A mode's value is read before records are joined to their groups."""
    from gaugeline.operators import partition as P

    text = "the pump leaks near weld number seven again today " * 200
    rows = spark.createDataFrame([(f"r{i}", None, "", "v", "aviation", None, f"{text}{i % 3}") for i in range(12)], "record_id string, event string, report_id string, vendor string, domain string, report_date string, narrative string")
    out = P.partition(rows, "industry", ["aviation"])
    assert {r.split for r in out.collect()} == {"test"} and "narrative" not in out._jdf.queryExecution().optimizedPlan().toString()
