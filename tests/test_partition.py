import json

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import contextual as X
from gaugeline.operators import display as D
from gaugeline.operators import evaluate as E
from gaugeline.operators import extract as EX
from gaugeline.operators import partition as P
from gaugeline.operators import review as R
from gaugeline.operators import snapshot
from gaugeline.plans.scoring import stub_parser

COLUMNS = "record_id string, event string, exact string, template string, domain string, year int, official string, excluded string"


def corpus(spark):
    rows = [
        ("1", "e1", "x1", None, "aviation", 2025, None, ""),
        ("2", "e1", "x2", "t", "aviation", 2025, None, ""),
        ("3", None, "x3", "t", "construction", 2010, "train", ""),
        ("4", "e2", "x4", None, "aviation", 2024, None, ""),
        ("5", "e2", "x5", None, "aviation", 2025, None, ""),
        ("6", None, "x6", None, "construction", 2010, "test", ""),
        ("7", None, "x6", None, "construction", 2010, "train", ""),
        ("8", None, "", None, "pipeline", 2026, None, ""),
        ("9", None, "", None, "pipeline", 2012, None, "short"),
    ]
    return P.policies(spark.createDataFrame(rows, COLUMNS), "seed")


def test_policies(spark):
    got = {r["record_id"]: r for r in corpus(spark).collect()}
    assert [got[i]["group_id"] for i in "123456789"] == ["1", "1", "1", "4", "4", "6", "6", "8", "9"]
    assert [got[i]["temporal"] for i in "12345"] == ["test", "test", "not_applicable", "quarantine", "quarantine"]
    assert got["3"]["official_safe"] == "train" and got["6"]["official_safe"] == got["7"]["official_safe"] == "quarantine"
    assert got["8"]["grouped"] == "demo" and {got["9"][c] for c in ("grouped", "temporal", "official_safe")} == {"excluded"}
    assert len({got[i]["grouped"] for i in "123"}) == 1


def test_hold_outs_take_what_is_connected(spark):
    got = {r["record_id"]: r for r in P.hold_outs(corpus(spark)).collect()}
    assert got["1"]["holdout_construction"] == got["3"]["holdout_aviation"] == "test"
    assert got["4"]["holdout_construction"] in ("train", "validation") and got["8"]["holdout_pipeline"] == "demo"


def reports(spark):
    rows = [
        ("1", "e", "r1", "Acme  Ltd", "aviation", "2024-01-01", "one two three"), ("2", "e", "r2", "Other", "pipeline", "2025-06-01", "four five six"),
        ("3", None, "", "acme ltd", "pipeline", None, "seven eight nine"), ("4", None, "r4", "Third", "construction", "2026-01-01", "a wholly different text"),
    ]
    return spark.createDataFrame(rows, "record_id string, event string, report_id string, vendor string, domain string, report_date string, narrative string")


def test_partition_modes(spark):
    rows = reports(spark)
    of = lambda *a, **k: {r["record_id"]: r["split"] for r in P.partition(rows, *a, **k).collect()}
    assert of()["1"] == of()["2"]
    got = of("vendor", ["ACME LTD"])
    assert got["1"] == got["2"] == got["3"] == "test" and got["4"] != "test"
    assert of("industry", ["pipeline"])["1"] == "test" and of("industry", ["pipeline"])["4"] != "test"
    got = of("temporal", train_end="2024-12-31", validation_end="2025-12-31")
    assert got == {"1": "quarantine", "2": "quarantine", "3": "quarantine", "4": "test"}
    for args in (("nonsense",), ("vendor",), ("temporal",), ("vendor", ["nobody"])):
        with pytest.raises(ValueError):
            P.partition(rows, *args)
    with pytest.raises(ValueError):
        P.partition(rows, "temporal", train_end="2025-01-01", validation_end="2024-01-01")


def test_quota_fills_up_and_fails_when_short(spark):
    rows = spark.createDataFrame([(f"{label}{i}", "d", label, f"{i}{label}") for label, n in (("a", 1), ("b", 6)) for i in range(n)], "record_id string, domain string, label string, sample_rank string")
    take = lambda n: sorted(r["record_id"] for r in P.quota_with_refill(rows, spark.createDataFrame([("d", n)], "domain string, quota long"), ["domain"]).collect())
    assert take(4) == ["a0", "b0", "b1", "b2"] and take(7) == ["a0", *[f"b{i}" for i in range(6)]]
    with pytest.raises(Exception, match="too few rows"):
        take(8)


def test_risky_records_are_replaced(spark):
    pool = spark.createDataFrame([(str(i), "d", f"{i}") for i in range(6)], "record_id string, domain string, sample_rank string")
    picked, risky = pool.where("record_id < 3"), pool.where("record_id in (1, 3)").select("record_id")
    assert sorted(r["record_id"] for r in P.swap_risky(picked, pool, risky, ["domain"]).collect()) == ["0", "2", "4"]
    with pytest.raises(ValueError):
        P.swap_risky(picked, pool, pool.where("record_id <> 0").select("record_id"), ["domain"])


def test_snapshots_are_frozen_and_verified(spark, tmp_path):
    assigned = corpus(spark).withColumn("selected", F.col("record_id").isin("1", "3"))
    records = assigned.select("record_id", "domain", F.concat(F.lit("text "), "record_id").alias("clean_text"))
    path = str(tmp_path / "s")
    manifest = snapshot.freeze(records, assigned, path, {"seed": "seed"})
    assert {p: x["rows"] for p, x in manifest["parts"].items()} == {"assignments": 9, "cleaned": 9, "cleaned_lines": 9, "training_sample": 2}
    assert snapshot.verify(spark, path).count() == 0
    assert {r["record_id"]: r["experiment"] for r in spark.read.json(f"{path}/training_sample").collect()} == {"1": "temporal", "3": "official_safe"}
    with pytest.raises(FileExistsError):
        snapshot.freeze(records, assigned, path, {})
    spark.createDataFrame([("99", "aviation", "planted")], records.schema).write.mode("append").parquet(f"{path}/cleaned")
    assert {tuple(r) for r in snapshot.verify(spark, path).collect()} == {("cleaned", "checksum"), ("cleaned_lines", "missing:99"), ("assignments", "extra:99")}


def test_gold_behind_a_manifest(spark, tmp_path):
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold/a.json").write_text('{"record_id": "1"}\n')
    told = {"input_sha256": snapshot.fingerprint(spark, str(tmp_path / "gold")), "labels": ["DEFECT"]}
    snapshot.write_new(spark, str(tmp_path / "m.json"), json.dumps(told))
    assert snapshot.read_gold(spark, str(tmp_path / "gold"), str(tmp_path / "m.json"), ["DEFECT"])[1].count() == 1
    with pytest.raises(ValueError):
        snapshot.read_gold(spark, str(tmp_path / "gold"), str(tmp_path / "m.json"), ["CAUSE"])
    with pytest.raises(Exception):
        snapshot.write_new(spark, str(tmp_path / "m.json"), "again")


def test_pairing_is_strict(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "record_id string")
    assert E.paired(ids("a", "b"), ids("b", "a").withColumn("n", F.lit(1))).count() == 2
    for other in (ids("a"), ids("a", "b", "b"), ids("a", "b", "c")):
        with pytest.raises(Exception, match="not one prediction"):
            E.paired(ids("a", "b"), other.withColumn("n", F.lit(1))).collect()


def test_sealed_tests_refuse_what_the_model_saw(spark):
    ids = spark.createDataFrame([("a", "test"), ("b", "train")], "record_id string, split string")
    rows, train = ids.select("record_id"), ids.where("split = 'train'").select("record_id")
    assert E.sealed(rows, ids)[0] == "no_learned_model" and E.sealed(rows, ids, train)[0] == "unverified_model_training_isolation"
    assert E.sealed(rows, ids, train, provenance="human_adjudicated_gold", trained_on="m", manifest="m")[0] == "verified_manifest"
    for seen, known in ((rows, {}), (train, {"provenance": "human_adjudicated_gold", "trained_on": "x", "manifest": "m"})):
        with pytest.raises(ValueError):
            E.sealed(rows, ids, seen, **known)
    with pytest.raises(ValueError):
        E.sealed(rows, ids.where("split = 'train'"))


def test_contextual_evidence_needs_a_parser(spark):
    rows = spark.createDataFrame([("1", "The gear is cracked; the bolt was inspected.", "general"), ("2", "Body made of plate, cracked.", "general")], "record_id string, narrative string, domain string")
    found = EX.extract(rows)
    got = {r["record_id"]: [(e["label"], e["text"], e["method"]) for e in r["entities"]] for r in X.add_contextual(found, X.available(stub_parser, X.PARSER_VERSION)).collect()}
    assert got["1"] == [("COMPONENT", "gear", "contextual"), ("DEFECT", "cracked", "ruler")]
    assert ("MATERIAL", "plate", "contextual") in got["2"] or ("COMPONENT", "plate", "contextual") in got["2"]
    assert X.available(stub_parser, "0") is None and X.add_contextual(found, None) is found


def test_payload_recomputes_findings(spark):
    rows = spark.createDataFrame([("1", "Steel valve cracked and the pump exhibits flensing. Bolt leaking.", "pipeline")], "record_id string, narrative string, domain string")
    found = EX.extract(rows)
    edits = spark.createDataFrame([("1", "DEFECT", 12, 19, "negated"), ("1", "COMPONENT", 6, 11, "present")], "record_id string, label string, start int, stop int, assertion string")
    row = R.payload(found, edits, F.lit(" seen ")).first()
    assert row["note"] == "seen" and [e["method"] for e in row["corrected_entities"]] == ["human", "human"]
    assert [(f["defect"]["assertion"], f["tier"], [e["text"] for e in f["links"]]) for f in row["corrected_findings"]] == [("negated", "low", ["valve"])]
    assert "exhibits flensing" in row["corrected_review_candidates"][0]["text"] and len(row["original_entities"]) == 4
    none = spark.createDataFrame([], "finding_id string, label string, start int, stop int")
    assert [f["links"] for f in R.payload(found, edits, F.lit(""), links=none).first()["corrected_findings"]] == [[]]


def test_display(spark):
    rows = spark.createDataFrame([("r0000000012", "f.csv", None, 3)], "record_id string, source_document string, vendor string, source_row int")
    assert D.choices(rows).first()["label"] == "f.csv · Unknown · 3 · 00000012"
    assert D.blank_predictions(rows.withColumn("entities", F.lit(1))).columns == rows.columns


def test_partition_manifest_pilot_and_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("{}")
    assigned = spark.createDataFrame([("1", "g", "test"), ("2", "h", "train")], "record_id string, group_id string, split string")
    told = snapshot.write_partition(spark, str(tmp_path / "p"), assigned, "vendor", str(tmp_path / "in"), ["DEFECT"], ["acme"])
    assert told["splits"] == {"test": 1, "train": 1} and json.loads((tmp_path / "p/manifest.json").read_text()) == told
    assert snapshot.read_gold(spark, str(tmp_path / "in"), str(tmp_path / "p/manifest.json"), ["DEFECT"])[0]["mode"] == "vendor"
    with pytest.raises(Exception):
        snapshot.write_partition(spark, str(tmp_path / "p"), assigned, "vendor", str(tmp_path / "in"), [])
    with pytest.raises(ValueError):
        snapshot.write_partition(spark, str(tmp_path / "q"), assigned.withColumn("group_id", F.lit("g")), "vendor", str(tmp_path / "in"), [])
    rows = spark.createDataFrame([("1", "d", "train", "f", True, ""), ("2", "d", "test", "f", False, "empty")], "record_id string, domain string, split string, file string, sensitive boolean, excluded string")
    found = snapshot.write_pilot(rows, str(tmp_path / "pilot"))
    assert {(a["column"], a["value"], a["records"], a["redacted"], a["excluded"]) for a in found["audit"]} == {("domain", "d", 2, 1, 1), ("file", "f", 2, 1, 1), ("split", "test", 1, 0, 1), ("split", "train", 1, 1, 0)}
    picked = rows.select("record_id", F.lit("text").alias("clean_text"), F.lit(1).alias("prediction"))
    with pytest.raises(ValueError):
        snapshot.write_batch(picked, rows.where("record_id = 1"), str(tmp_path / "b"))
    snapshot.write_batch(picked, rows, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b")).columns == ["clean_text", "record_id"]


def test_what_contextual_evidence_refuses(spark):
    """One sentence a case: the chunk is a word of it with a role, a lemma and a head, or leaves no words, or words apart."""
    t = lambda text, word, kind="NOUN": X.Token(text.index(word), text.index(word) + len(word), kind)

    def chunk(text, said, role="nsubj", lemma="flange", head="be", kinds=None):
        at = text.index(said)
        tokens = [t(text, w, (kinds or {}).get(w, "NOUN")) for w in said.split()]
        return X.Chunk(at, at + len(said), role, lemma, head, tokens)

    far = "The flange " + "is really " * 12 + "cracked."
    cases = {
        "kept": ("The flange is cracked.", [dict(said="The flange", kinds={"The": "DET"})], [("COMPONENT", "flange")]),
        "two words": ("The top flange is cracked.", [dict(said="top flange", kinds={"top": "ADJ"})], [("COMPONENT", "top flange")]),
        "role": ("One flange is cracked.", [dict(said="flange", role="attr")], []),
        "lemma": ("The Report is cracked.", [dict(said="Report", lemma="Report")], []),
        "reported": ("The flange found cracked.", [dict(said="flange", head="Find")], []),
        "reported, but not as its subject": ("On the flange found cracked.", [dict(said="flange", head="Find", role="pobj")], [("COMPONENT", "flange")]),
        "reported with the defect in it": ("The cracked flange noted.", [dict(said="cracked flange", head="note")], [("COMPONENT", "flange")]),
        "no words of its own": ("It is cracked.", [dict(said="It", kinds={"It": "PRON"})], []),
        "words apart": ("A flange of hub is cracked.", [dict(said="flange of hub", kinds={"of": "ADP"})], []),
        "marked up before": ("See </flange is cracked.", [dict(said="flange")], []),
        "marked up behind": ("See flange> is cracked.", [dict(said="flange")], []),
        "far": (far, [dict(said="flange")], []),
        "no defect": ("The flange is here.", [dict(said="flange")], []),
        "material": ("Made of flange and cracked.", [dict(said="flange")], [("COMPONENT", "flange")]),
    }
    said = {text: [chunk(text, **c) for c in chunks] for text, chunks, _ in cases.values()}
    trimmed = {text.rstrip("."): chunks for text, chunks in said.items()}

    def parser(texts):
        return [trimmed.get(x.strip().rstrip("."), []) if not x.startswith("flange and") else [X.Chunk(0, 6, "pobj", "flange", "of", [X.Token(0, 6, "NOUN")])] for x in texts]

    rows = spark.createDataFrame([(name, text, "general") for name, (text, _, _) in cases.items()], "record_id string, narrative string, domain string")
    out = X.add_contextual(EX.extract(rows), parser)
    got = {r["record_id"]: [(e["label"], e["text"]) for e in r["entities"] if e["method"] == "contextual"] for r in out.collect()}
    want = {name: found for name, (_, _, found) in cases.items()}
    material = got.pop("material")
    want.pop("material")
    assert got == want
    assert len(material) == 1 and material[0][1] == "flange"  # what both rules find stands once


def test_files_are_hashed_whole_or_as_streams(spark, tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "y").mkdir()
    contents = {"x/part": b"one", "y/part": b"two", "large": bytes(range(256)) * 40}
    for name, content in contents.items():
        (tmp_path / "in" / name).write_bytes(content)
    told = lambda: {r.path.split("/in/")[1]: r.sha256 for r in snapshot.checksums(spark, str(tmp_path / "in")).collect()}
    want = {name: hashlib.sha256(content).hexdigest() for name, content in contents.items()}
    before = snapshot.fingerprint(spark, str(tmp_path / "in"))
    assert told() == want
    monkeypatch.setattr(snapshot, "WHOLE", 5)
    assert told() == want and snapshot.fingerprint(spark, str(tmp_path / "in")) == before
    assert snapshot.file_hash(spark, str(tmp_path / "in" / "large")) == want["large"]
    (tmp_path / "in/x/part").write_bytes(b"two")
    (tmp_path / "in/y/part").write_bytes(b"one")  # files of one name that change places are told apart
    assert snapshot.fingerprint(spark, str(tmp_path / "in")) != before


def test_a_file_is_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "profile.json")
    for text in ("first", "second"):
        snapshot.replace_file(spark, path, text)
        assert snapshot.read_text(spark, path) == text
    assert not snapshot.exists(spark, f"{path}.new")
