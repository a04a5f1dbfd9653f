"""Arrays are computed once: no filter asks for them below, and repeated texts are extracted for one record each."""

from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators import analytics as A
from gaugeline.operators import extract as X

COLUMNS = "record_id string, narrative string, domain string, report_id string, vendor string, report_date string, report_status string"


def reports(spark):
    texts = ["Steel anvil cracked at 5 mm.", "No crack observed on the ring.", None, "", "Pipe cracked; copper housing leaking.", "Critical steel rod worn. Replace immediately."]
    return spark.createDataFrame([(f"r{i}", texts[i % 6], ("pipeline", "general")[i % 4 // 2], f"p{i % 9}", "v", None, None) for i in range(240)], COLUMNS)


def test_no_filter_computes_arrays_again(spark):
    rows = reports(spark)
    found = X.findings(X.extract(rows))
    for df in (A.finding_rows(found), A.entity_counts(found), A.cooccurrence(found, "COMPONENT"), T.unfold(found, "entities", "e")):
        assert "Filter (size" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_unfold_gives_each_element_once(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, xs array<string>")
    assert [tuple(r) for r in T.unfold(rows, "xs", "x", "id").orderBy("x").collect()] == [(1, "a"), (1, "b")]


def test_once_a_text_equals_each_record(spark):
    rows, calls = reports(spark), spark.sparkContext.accumulator(0)
    work = lambda r: X.findings(X.extract(r))
    shown = lambda df: sorted(df.select("record_id", "narrative", F.to_json(F.struct(*[c for c in df.columns if c not in rows.columns])).alias("x")).collect(), key=repr)
    assert shown(X.once_a_text(rows, work)) == shown(work(rows)) and calls.value == 0

    @F.udf("int")
    def asked(text):
        if text is not None:
            calls.add(1)
        return 0

    X.once_a_text(rows, lambda r: r.withColumn("n", asked.asNondeterministic()("narrative"))).collect()
    assert 0 < calls.value <= 5 * 2 * X.SHARES


def test_a_text_is_worked_on_once(spark):
    rows, calls = reports(spark), spark.sparkContext.accumulator(0)

    @F.udf("int")
    def asked(text):
        if text is not None:
            calls.add(1)
        return 0

    got = X.once_a_text(rows, lambda r: r.withColumn("n", asked.asNondeterministic()("narrative"))).collect()
    assert len(got) == 240 and 0 < calls.value <= 5 * 2


def test_once_a_text_with_texts_of_both_kinds(spark, monkeypatch):
    """Some texts are frequent, handed out by broadcast, the others joined by shuffle; null texts and domains too."""
    monkeypatch.setattr(X, "SHARES", 12)
    rows = reports(spark).withColumn("domain", F.when(F.col("record_id") != "r7", F.col("domain"))).unionByName(spark.createDataFrame([("x", "Rare dent.", "general", "p", "v", None, None)], COLUMNS))
    work = lambda r: X.findings(X.extract(r))
    shown = lambda df: sorted(df.select("record_id", "narrative", "domain", F.to_json("findings").alias("f"), F.to_json("entities").alias("e")).collect(), key=repr)
    assert shown(X.once_a_text(rows, work)) == shown(work(rows))


def test_edited_links_ask_for_spans_and_findings_once(spark):
    from gaugeline.operators.review import edited_links

    calls = {n: spark.sparkContext.accumulator(0) for n in ("spans", "findings")}

    def counting(name):
        count = calls[name]

        @F.udf("string")
        def seen(x):
            count.add(1)
            return x

        return seen.asNondeterministic()

    spans = spark.createDataFrame([("r1", "MATERIAL", 0, 5, "Steel"), ("r1", "MATERIAL", 0, 5, "steel")], "record_id string, label string, start int, stop int, text string").withColumn("text", counting("spans")("text"))
    found = spark.createDataFrame([("r1:defect:9",)], "finding_id string").withColumn("finding_id", counting("findings")("finding_id"))
    edits = spark.createDataFrame([("r1:defect:9", "r1", "MATERIAL", 0, 5), ("r1:defect:9", "r1", "MATERIAL", 0, 5), ("r1:defect:8", "r1", "MATERIAL", 0, 5), ("r1:defect:9", "r1", "DATE", 0, 5)], "finding_id string, record_id string, label string, start int, stop int")
    links, wrong = edited_links(edits, spans, found)
    assert [(r.finding_id, r.label) for r in links.collect()] == [("r1:defect:9", "MATERIAL")]
    assert sorted((r.finding_id, r.label) for r in wrong.collect()) == [("r1:defect:8", "MATERIAL"), ("r1:defect:9", "DATE")]
    assert calls["spans"].value == 2 and calls["findings"].value == 1


def test_work_is_planned_once_and_rows_are_made_once_a_text(spark):
    rows, calls = reports(spark), []

    def work(r):
        calls.append(1)
        return A.with_shown(X.findings(X.extract(r)))

    found = X.once_a_text(rows, work)
    shown = lambda df: sorted(map(tuple, A.finding_rows(df).collect()), key=repr)
    assert len(calls) == 1 and "shown" in found.columns
    assert shown(found) == shown(X.findings(X.extract(rows))) and "shown" not in A.export_scope(found, A.finding_rows(found)).columns
