import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import snapshot
from gaugeline.sources import config as Cf
from gaugeline.sources import readers as S

PACK = '{"version": "v1", "entities": {"COMPONENT": ["Seal", "fire door"], "MATERIAL": ["oak"]}}'


def test_terminology_is_validated_and_versioned(spark):
    one = Cf.terminology({"a.json": PACK})
    assert one.version.startswith("v1:") and one.packs[0]["MATERIAL"] == ["oak"]
    assert {(r["label"], r["term"]) for r in one.table(spark).collect()} == {("COMPONENT", "seal"), ("COMPONENT", "fire door"), ("MATERIAL", "oak")}
    two = Cf.terminology({"a.json": PACK, "b.json": PACK.replace("v1", "v2")})
    assert two.version.startswith("v1+v2:") and two.version.split(":")[1] != one.version.split(":")[1]
    bad = ['{"entities": {}}', '{"version": 1}', '{"version": 1, "entities": []}', '{"version": 1, "entities": {"NONSENSE": ["x"]}}', '{"version": 1, "entities": {"CAUSE": "x"}}', '{"version": 1, "entities": {"CAUSE": [1]}}', "[]"]
    for content in bad:
        with pytest.raises(ValueError):
            Cf.terminology({"a.json": content})


def test_terminology_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text("version: p-1\nentities:\n  CAUSE: [frost heave]\n")
    from gaugeline.operators.extract import extract

    packs = Cf.load_terminology(spark, [str(tmp_path / "p.yaml")]).packs
    rows = spark.createDataFrame([("r", "Frost heave cracked it.", "general")], "record_id string, narrative string, domain string")
    assert [(e["label"], e["text"]) for e in extract(rows, packs=packs).first()["entities"]] == [("CAUSE", "Frost heave"), ("DEFECT", "cracked")]


def test_profiles(spark, tmp_path):
    path = str(tmp_path / "profiles.json")
    assert Cf.load_profiles(spark, path) == {}
    Cf.save_profile(spark, path, " acme ", {"vendor": "Supplier"})
    Cf.save_profile(spark, path, "other", {"batch": "Lot"})
    Cf.save_profile(spark, path, "acme", {"vendor": "Company"})
    assert Cf.load_profiles(spark, path) == {"acme": {"vendor": "Company"}, "other": {"batch": "Lot"}}
    for name, profile in ((" ", {}), ("x", {"nonsense": "y"})):
        with pytest.raises(ValueError):
            Cf.save_profile(spark, path, name, profile)


def review(record, at, **more):
    return {"reviewed_at": at, "record_id": record, "domain": "general", "corrected_entities": [], "note": ""} | more


def test_review_history(spark, tmp_path):
    path = str(tmp_path / "h")
    assert Cf.review_history(spark, path).count() == 0
    entities = "array<struct<label:string,start:int,stop:int,text:string,assertion:string>>"
    kind = f"reviewed_at string, record_id string, domain string, corrected_entities {entities}, note string"
    for record, at in (("a", "2026-01-01"), ("b", "2026-02-01")):
        Cf.append_reviews(spark.createDataFrame([(at, record, "general", [("DEFECT", 0, 4, "leak", "present")], "n")], kind), path)
    assert [(r["record_id"], r["line"]) for r in Cf.review_history(spark, path).collect()] == [("b", 1), ("a", 1)]
    for lines, match in (([json.dumps(review("a", "1")), "{"], "line 2"), (['{"record_id": "a"}'], "incomplete review on line 1")):
        (tmp_path / "bad.json").write_text("\n".join(lines))
        with pytest.raises(Exception, match=match):
            Cf.review_history(spark, str(tmp_path / "bad.json")).collect()


def test_sqlite_is_read_only(spark, tmp_path):
    path = str(tmp_path / "x.sqlite")
    con = sqlite3.connect(path)
    con.execute("create table records (idx integer, name text, score real, other blob)")
    con.executemany("insert into records values (?, ?, ?, ?)", [(i, f"n{i}" if i % 2 else None, i / 2, b"x") for i in range(12_000)])
    con.commit()
    con.close()
    rows = Cf.sqlite_table(spark, path, "records", ["idx", "name", "score"])
    assert rows.dtypes == [("idx", "bigint"), ("name", "string"), ("score", "double")]
    assert rows.count() == 12_000 and rows.where("name is null").count() == 6000 and rows.agg(F.sum("idx")).first()[0] == sum(range(12_000))
    with pytest.raises(ValueError):
        Cf.sqlite_table(spark, path, "nothing")
    with pytest.raises(sqlite3.OperationalError):
        Cf.sqlite_table(spark, str(tmp_path / "absent.sqlite"), "records")


def test_pasted_and_demo(spark):
    assert Cf.pasted(spark, "Valve cracked.").first()["path"] == "pasted.txt" and Cf.pasted(spark, "  ").count() == 0
    rows = spark.createDataFrame([("Loom is cracked.", "Acme", "2026-1-2", "R1", "P", "B", "A")], "Inspection string, Company string, InspectionDate string, ReportNumber string, Product string, Batch string, Asset string")
    row = Cf.demo_records(rows).first()
    assert (row["vendor_key"], row["report_date"], row["report_id"], row["asset_id"]) == ("acme", "2026-01-02", "R1", "A")


def test_models_are_kept_with_a_checksum(spark, tmp_path):
    from gaugeline.operators import classify

    rows = spark.createDataFrame([("leak leak here", "a"), ("crack crack there", "b")] * 4, "text string, label string")
    model = classify.train(rows, iterations=5)
    told = Cf.save_model(model, str(tmp_path / "m"), {"task": "t"})
    assert json.loads(snapshot.read_text(spark, str(tmp_path / "m/metadata.json"))) == told
    loaded = Cf.load_model(spark, str(tmp_path / "m/model"), told["sha256"])
    assert {r["predicted"] for r in classify.predict(loaded, rows).collect()} == {"a", "b"}
    with pytest.raises(FileExistsError):
        Cf.save_model(model, str(tmp_path / "m"), {})
    with pytest.raises(ValueError):
        Cf.load_model(spark, str(tmp_path / "m/model"), "0" * 64)


def test_rows_are_numbered_by_file(spark, tmp_path):
    for name, n in (("a.csv", 5), ("b.csv", 3)):
        (tmp_path / name).write_text("English,Classification_English\n" + "".join(f'"line {i}\nof {name}",x\n' for i in range(n)))
    rows = S.numbered(S.delimited(spark, str(tmp_path)))
    by = {}
    for r in rows.collect():
        by.setdefault(r["English"].split()[-1], []).append((int(r["English"].split()[1]), r["source_row"]))
    assert by == {"a.csv": [(i, i + 2) for i in range(5)], "b.csv": [(i, i + 2) for i in range(3)]} or {k: sorted(v) for k, v in by.items()} == {"a.csv": [(i, i + 2) for i in range(5)], "b.csv": [(i, i + 2) for i in range(3)]}
    found = S.source_records(rows.where("English like '%a.csv'"), "fire_door", "/d/a.xlsx").collect()
    assert {r["source_record_id"] for r in found} == {f"a:{i + 2}" for i in range(5)}
    assert found[0]["display_text"].count("\n") == 1 and "\n" not in found[0]["narrative"]
    with pytest.raises(ValueError):
        S.source_records(S.delimited(spark, str(tmp_path)), "fire_door", "/d/a.xlsx")
