import pytest
from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators import analytics as A
from gaugeline.operators import extract as X
from gaugeline.operators import review as R


def run(spark, *texts, domain="pipeline", enabled=True, packs=(), **columns):
    rows = [(f"r{i}", t, domain) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "record_id string, narrative string, domain string")
    for name, value in columns.items():
        df = df.withColumn(name, value if not isinstance(value, str) else F.lit(value))
    return X.findings(X.extract(df, packs), enabled=enabled)


@pytest.mark.parametrize(
    "sentence, expected",
    [
        ("No crack was seen on the housing.", "negated"),
        ("A possible crack was seen.", "possible"),
        ("The crack was repaired.", "resolved"),
        ("Previously a crack was logged.", "historical"),
        ("A crack was seen.", "present"),
        ("Team failed to find crack marks.", "negated"),
        ("The crack is suspected.", "possible"),
        ("The crack was not found.", "negated"),
    ],
)
def test_assertions(spark, sentence, expected):
    entities = run(spark, sentence).first()["entities"]
    assert [e["assertion"] for e in entities if e["text"].lower() == "crack"] == [expected]


def test_scope_ends_with_the_clause(spark):
    row = run(spark, "No crack observed, but valve leaking.").first()
    assert [f["defect"]["assertion"] for f in row["findings"]] == ["negated", "present"]


def test_offsets_spans_and_precedence(spark):
    text = "😀 Stainless steel valve, external corrosion 2.5 mm on 2024-05-06; failed to detect leaks 10 % ok."
    row = run(spark, text).first()
    assert all(text[e["start"] : e["stop"]] == e["text"] for e in row["entities"])
    assert [(e["label"], e["text"]) for e in row["entities"]] == [
        ("MATERIAL", "Stainless steel"), ("COMPONENT", "valve"), ("CAUSE", "external corrosion"), ("MEASUREMENT", "2.5 mm"), ("DATE", "2024-05-06"), ("DEFECT", "leaks"), ("MEASUREMENT", "10 %"),
    ]


def test_longer_terms_win_wherever_they_start(spark):
    row = run(spark, "door closer adjustment defect", domain="construction").first()
    assert [e["text"] for e in row["entities"]] == ["closer adjustment defect"]


def test_links_and_ambiguity(spark):
    found = run(spark, "Steel valve cracked at 3 mm; copper pipe leaking.", "Valve and pipe cracked and leaking.", "Valve pipe leaking.").collect()
    one, two = found[0]["findings"]
    assert {e["text"] for e in one["links"]} == {"Steel", "valve", "3 mm"} and {e["text"] for e in two["links"]} == {"copper", "pipe"}
    assert not one["ambiguous"] and all(f["ambiguous"] and not f["links"] for f in found[1]["findings"])
    assert found[2]["findings"][0]["ambiguous"] and not found[2]["findings"][0]["links"]


def test_clauses_do_not_end_after_digits(spark):
    text = "Valve cracked at 15. Copper pipe; however pump worn and the seal is torn"
    got = spark.createDataFrame([(text,)], "t string").select(X.clauses(F.col("t")).alias("c")).first()["c"]
    assert [text[c["start"] : c["stop"]].strip() for c in got] == ["Valve cracked at 15. Copper pipe", "pump worn", "the seal is torn"]


def test_priorities(spark):
    rows = run(spark, "Critical valve cracked.", "Minor valve cracked.", "No severe crack found.", "Valve cracked. Critical.", "Valve leaking, urgent repair.", "Valve repaired at site.").collect()
    assert [[f["tier"] for f in r["findings"]] for r in rows] == [["high"], ["normal"], ["low"], ["normal"], ["high"], []]
    assert [r["reported_severity"] for r in rows[:3]] == ["Critical", "Minor", None]
    assert [r["review_priority"] for r in rows] == [3.0, 2.0, 1.0, 2.0, 3.0, 2.0]
    assert run(spark, "Valve cracked.", enabled=False).first()["review_priority"] is None


def test_unsupported_clauses_and_absences(spark):
    row = run(spark, "Valve exhibits flensing. No defects were found.").first()
    assert [c["text"] for c in row["review_candidates"]] == ["Valve exhibits flensing"]
    assert [a["text"] for a in row["absences"]] == ["No defects were found"]
    assert row["mapping_status"] == "review_required"
    assert run(spark, "All good here.").first()["mapping_status"] == "unmapped"
    assert run(spark, None).first()["entities"] is None or run(spark, None).first()["entities"] == []


def test_vendor_rates_keep_denominators(spark):
    cols = {"vendor": F.when(F.col("record_id") == "r2", "B").otherwise("A"), "report_id": F.col("record_id"), "report_date": F.lit("2024-01-01"), "report_status": F.lit(None).cast("string")}
    found = run(spark, "Valve cracked.", "No crack found on the valve.", "Valve leaking.", **cols)
    rates = {r["vendor"]: (r["inspected_reports"], r["affected_reports"], r["affected_report_rate"]) for r in A.vendor_rates(found, A.finding_rows(found, defect=["crack"], assertion=["present"])).collect()}
    assert rates == {"A": (2, 1, 50.0), "B": (1, 0, 0.0)}
    out = A.export_scope(found, A.finding_rows(found, defect=["crack"], assertion=["present"]))
    assert out.count() == 3 and out.where("size(findings) > 0").count() == 1


def test_recurrence(spark):
    cols = {"vendor": F.lit("V"), "report_id": F.col("record_id"), "batch": F.lit(None).cast("string"), "report_status": F.lit(None).cast("string")}
    cols["asset_id"] = F.when(F.col("record_id") != "r2", "a1")
    cols["report_date"] = F.when(F.col("record_id") == "r0", "2026-01-05").otherwise("2026-02-05")
    found = run(spark, "Valve cracked.", "Pipe cracked.", "Pipe cracked.", **cols)
    assert [tuple(r) for r in A.recurrence(found).collect()] == [("r1:defect:5", ["r0:defect:6"])]


def test_recurrence_needs_a_vendor(spark):
    cols = {"vendor": F.lit(" "), "report_id": F.col("record_id"), "batch": F.lit("b1"), "report_status": F.lit(None).cast("string"), "asset_id": F.lit(None).cast("string")}
    cols["report_date"] = F.when(F.col("record_id") == "r0", "2026-01-05").otherwise("2026-02-05")
    rows = run(spark, "Valve cracked.", "Pipe cracked.", **cols)
    assert A.recurrence(rows).count() == 0
    assert A.recurrence(rows.withColumn("vendor", F.lit("V"))).count() == 1


def test_rates_of_one_pass_equal_those_of_rows(spark):
    cols = {"vendor": F.when(F.col("record_id") == "r2", "B").otherwise("A"), "report_id": F.col("record_id"), "report_date": F.lit("2024-01-01"), "report_status": F.lit(None).cast("string")}
    found = run(spark, "Valve cracked.", "No crack found on the valve.", "Valve leaking.", **cols)
    rows, crack = A.finding_rows(found, defect=["crack"]), lambda f: f["category"] == "crack"
    same = lambda a, b: sorted(map(tuple, a.select(*sorted(a.columns)).collect())) == sorted(map(tuple, b.select(*sorted(b.columns)).collect()))
    assert same(A.vendor_rates_of(found, crack), A.vendor_rates(found, rows))
    assert same(A.monthly_trends_of(found, crack), A.monthly_trends(found, rows))


def test_text_functions(spark):
    df = spark.createDataFrame([(" a  b\tc ", "Valve 12.5 leaks near the old pump house 7", "=1+1")], "a string, b string, c string")
    row = df.select(T.collapse(F.col("a")).alias("a"), T.template_key(F.col("b")).alias("t"), T.template_key(F.lit("Valve 99 leaks near the old pump house, 8")).alias("u"), T.template_key(F.lit("10 mm gap")).alias("n"), T.spreadsheet_safe(F.col("c")).alias("c"), T.nfkc(F.lit("ﬁne")).alias("k"), T.offset_map(F.lit("ab  c")).alias("o"), T.exact_key(F.lit("")).alias("e")).first()
    assert row["a"] == "a b c" and row["t"] == row["u"] and row["n"] is None and row["c"] == "'=1+1" and row["k"] == "fine" and row["o"] == [0, 1, 2, 4, 5] and row["e"] == ""


def test_redaction_and_risks(spark):
    texts = ["mail a@b.org now", "call (555) 123-4567", "at 12.12345, -45.12345", "lat: 12.5", "12 Old Mill Road.", "plain", "N123AB and inspector Jane Doe"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.prepare(F.col("t")).alias("p"), T.risks(F.col("t")).alias("r")).collect()
    assert [r["p"]["sensitive"] for r in rows] == [True] * 5 + [False, False]
    assert rows[0]["p"]["text"] == "mail [REDACTED] now" and rows[6]["r"] == ["personal_name", "registration"] and rows[0]["r"] == ["email", "redaction_change"]


def test_redaction_knows_letters_beyond_ascii(spark):
    texts = ["Call josé@example.com now", "12 Größe Straße road", "éN123 and ÉN45", "tel é555-123-4567"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.prepare(F.col("t")).alias("p"), T.risks(F.col("t")).alias("r")).collect()
    assert rows[0]["p"]["text"] == "Call [REDACTED] now" and rows[0]["r"] == ["email", "redaction_change"]
    assert rows[1]["p"]["text"] == "[REDACTED]" and rows[2]["r"] == [] and not rows[3]["p"]["sensitive"]


def test_evidence_keeps_lines_and_offsets(spark):
    raw = "\r\n Valve\r\n  cracked.\rMail josé@example.com  today \n"
    row = spark.createDataFrame([(raw,), ("  ",), (None,)], "t string").select(T.prepare_evidence(F.col("t")).alias("p")).collect()
    p = row[0]["p"]
    assert p["display"] == "Valve\n  cracked.\nMail [REDACTED]  today" and p["clean"] == "Valve cracked. Mail [REDACTED] today" and p["sensitive"]
    assert len(p["offsets"]) == len(p["clean"]) + 1 and p["offsets"][-1] == len(p["display"])
    assert all(p["clean"][i] == p["display"][p["offsets"][i]] or p["clean"][i] == " " for i in range(len(p["clean"])))
    assert row[1]["p"]["display"] == "" and row[1]["p"]["offsets"] == [0] and row[2]["p"] is None


def test_hybrid_keeps_rules_first(spark):
    rows = run(spark, "Steel valve cracked")
    text = F.col("narrative")
    tagged = R.tagged_spans(text, T.find_spans(text, "Steel valve|cracked"), "COMPONENT")
    got = rows.select(R.hybrid(F.col("entities"), tagged, 0.95).alias("e")).first()["e"]
    assert [(e["text"], e["method"]) for e in got] == [("Steel valve", "ner"), ("cracked", "ner")]


def test_all_perturbations_run_over_all_reports(spark):
    from gaugeline.plans import ingest

    texts = [("a", "Steel ring cracked at 12 mm.", "Acme"), ("b", "Critical copper rod worn. Replace immediately.", "Acme"), ("c", "ACME bolt leaking.", "Acme"), ("d", "Cracked bolt leaking.", "Cracked bolt")]
    rows = spark.createDataFrame([(i, t, v, "general") for i, t, v in texts], "record_id string, narrative string, vendor string, domain string")
    found = {r["kind"]: (r["reports"], r["changed"]) for r in ingest.perturbed(rows).collect()}
    assert found == {"metadata": (4, 0), "spaces": (4, 0), "text": (2, 1)}


def test_case_folding_equals_pythons_on_every_character(spark):
    from gaugeline.functions import text as T

    rows = spark.createDataFrame([(i, f"a{chr(i)}B") for i in range(1, 0x110000, 1) if not 0xD800 <= i < 0xE000 and (chr(i).casefold() != chr(i) or i % 97 == 0)], "i int, t string")
    wrong = [(r.i, r.t, r.f) for r in rows.select("i", "t", T.casefold(F.col("t")).alias("f")).collect() if r.t.casefold() != r.f]
    assert not wrong, wrong[:5]
    odd = spark.createDataFrame([("Straße ﬁn İX",), ("",), (None,)], "t string").select("t", T.casefold(F.col("t")).alias("f")).collect()
    assert all(r.f == (r.t and r.t.casefold()) if r.t is not None else r.f is None for r in odd)
    assert spark.range(1).select(T.vendor_key(F.lit(" GROẞ  Straße "), {"gross strasse": "Gs"})).first()[0] == "gs"
