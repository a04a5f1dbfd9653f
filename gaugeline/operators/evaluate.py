"""Set-based evaluation of spans, relations, assertions and classes."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = ("record_id", "start", "stop", "label")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def metrics(predicted: DataFrame, gold: DataFrame, keys: Sequence[str], by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """predicted, reference, correct, precision, recall, f1 of two sets of keys; repeated keys count once.

    One aggregation over the union tells which side a key is on: no join.
    """
    sides = predicted.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("g")))
    each = sides.groupBy(*keys).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((F.col("p"), "predicted"), (F.col("g"), "reference"), (F.col("p") * F.col("g"), "correct"))]
    out = each.groupBy(*by).agg(*sums) if by else each.agg(*sums)
    p, r = _ratio(F.col("correct"), F.col("predicted")), _ratio(F.col("correct"), F.col("reference"))
    rounded = {"precision": p, "recall": r, "f1": _ratio(2 * p * r, p + r)}
    return out.withColumns({n: F.bround(c, digits) for n, c in rounded.items()})


def confusion(gold: DataFrame, predicted: DataFrame, value: str = "assertion") -> DataFrame:
    """Counts of (actual, predicted) over spans that both have."""
    other = predicted.select(*SPAN, F.col(value).alias("predicted"))
    return gold.select(*SPAN, F.col(value).alias("actual")).join(other, list(SPAN)).groupBy("actual", "predicted").agg(F.count("*").alias("count"))


def missed(gold: DataFrame, predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Gold defects that were missed, and how many of them overlap a review candidate."""
    lost = gold.where("label = 'DEFECT'").select(*SPAN).distinct().join(predicted.select(*SPAN), list(SPAN), "left_anti")
    near = candidates.select(F.col("record_id").alias("r"), F.col("start").alias("a"), F.col("stop").alias("b"))
    routed = lost.join(near, (F.col("record_id") == F.col("r")) & (F.col("a") < F.col("stop")) & (F.col("b") > F.col("start")), "left_semi")
    left, right = lost.agg(F.count("*").alias("missed_defects")), routed.agg(F.count("*").alias("routed"))
    return left.join(F.broadcast(right), F.lit(True)).withColumn("coverage", F.when(F.col("missed_defects") > 0, F.bround(F.col("routed") / F.col("missed_defects"), 6)))


def class_report(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """precision, recall, f1, support of each class seen on either side; support 0 marks a class that is only predicted."""
    cells = rows.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    long = cells.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")))).alias("x"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    out = long.groupBy("x.label").agg(F.sum("x.support").alias("support"), F.sum("x.said").alias("said"), (F.sum("hit") / 2).alias("hit"))
    p, r = _ratio(F.col("hit"), F.col("said")), _ratio(F.col("hit"), F.col("support"))
    return out.select("label", "support", F.bround(p, 6).alias("precision"), F.bround(r, 6).alias("recall"), F.bround(_ratio(2 * p * r, p + r), 6).alias("f1"))


def macro_weighted(report: DataFrame) -> DataFrame:
    return report.agg(F.bround(F.avg("f1"), 6).alias("macro_f1"), F.bround(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"))


def calibrate(predicted: DataFrame, gold: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = SPAN) -> DataFrame:
    """metrics at each threshold: a row counts for all thresholds up to its confidence."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    p = predicted.select(*keys, "confidence", each.alias("threshold")).where("confidence >= threshold")
    return metrics(p, gold.select(*keys, each.alias("threshold")), [*keys, "threshold"], ["threshold"])


def review_outcomes(original: DataFrame, corrected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confirmed, removed or changed, added or changed: sizes of the set operations, by one aggregation."""
    found = metrics(original, corrected, keys)
    return found.select(F.col("correct").alias("confirmed"), (F.col("predicted") - F.col("correct")).alias("removed_or_changed"), (F.col("reference") - F.col("correct")).alias("added_or_changed"))


def confidence_bands(rows: DataFrame) -> DataFrame:
    """rows(confidence, confirmed) to bands with rates."""
    c = F.col("confidence")
    band = F.when(c < 0.5, "0-49%").when(c < 0.75, "50-74%").when(c < 0.95, "75-94%").otherwise("95-100%")
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("findings"), F.count_if("confirmed").alias("confirmed")).withColumn("confirmation_rate", F.bround(F.col("confirmed") / F.col("findings") * 100, 1))


def paired(gold: DataFrame, predicted: DataFrame, key: str = "record_id") -> DataFrame:
    """gold joined to predicted by key; a record that only one side has, or one has twice, fails the query when it is run."""
    count = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    both = count(gold, "g").join(count(predicted, "p"), key, "full")
    bad = (F.coalesce("g", F.lit(0)) != 1) | (F.coalesce("p", F.lit(0)) != 1)
    checked = both.select(F.when(bad, F.raise_error(F.concat(F.lit("not one prediction for "), key)).cast("string")).otherwise(F.col(key)).alias(key))
    return checked.join(gold, key).join(predicted, key)


def per_label(predicted: DataFrame, gold: DataFrame, labels: Sequence[str]) -> DataFrame:
    """metrics of each label of a fixed list, in its order (place); a label that neither side has scores 0."""
    frame = predicted.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, place int")
    found = metrics(predicted, gold, SPAN, ["label"])
    zero = {**dict.fromkeys(("predicted", "reference", "correct"), 0), **dict.fromkeys(("precision", "recall", "f1"), 0.0)}
    return F.broadcast(frame).join(found, "label", "left").fillna(zero)


def errors(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(record_id, kind, start, stop, label): entities that were missed and such as the reference lacks."""
    sides = predicted.select(*SPAN, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select(*SPAN, F.lit(0).alias("p"), F.lit(1).alias("g")))
    each = sides.groupBy(*SPAN).agg(F.max("p").alias("p"), F.max("g").alias("g")).where("p <> g")
    return each.select("record_id", F.when(F.col("p") == 1, "extra_entity").otherwise("missed_entity").alias("kind"), "start", "stop", "label")


def sliced(predicted: DataFrame, gold: DataFrame, records: DataFrame, slices: Sequence[str]) -> DataFrame:
    """metrics by (field, value) for several slice columns of records in one pass: each record counts once in each field."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias("value")) for c in slices])
    of = records.select("record_id", F.explode(pairs).alias("s")).select("record_id", "s.field", "s.value")
    keys = [*SPAN, "field", "value"]
    return metrics(predicted.select(*SPAN).distinct().join(of, "record_id"), gold.select(*SPAN).distinct().join(of, "record_id"), keys, ["field", "value"])


def best_threshold(calibrated: DataFrame) -> DataFrame:
    """The row of the largest f1; of equal ones the larger threshold."""
    row = F.struct(*calibrated.columns)
    return calibrated.agg(F.max_by(row, F.struct("f1", "threshold")).alias("r")).select("r.*")


def held_out_scores(predicted: DataFrame, gold: DataFrame, domains: DataFrame, labels: DataFrame) -> DataFrame:
    """metrics by domain over the labels (domain, label) that training for its test had; domains(record_id, domain)."""
    known = F.broadcast(labels.distinct())
    side = lambda x: x.select(*SPAN).join(domains, "record_id").join(known, ["domain", "label"], "left_semi")
    found = metrics(side(predicted), side(gold), [*SPAN, "domain"], ["domain"])
    names = labels.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("compatible_labels"))
    counts = domains.groupBy("domain").agg(F.count("*").alias("records"))
    return counts.join(names, "domain").join(found, "domain", "left").fillna(0)


def isolation(test: DataFrame, seen: DataFrame | None, provenance: str | None = None, trained_on: str | None = None, manifest: str | None = None) -> str:
    """What is known of a model that is to be scored on sealed test records; one that saw any of them is refused.

    seen(record_id): what it was trained on or chosen by; None without a model.
    """
    if seen is None:
        return "no_learned_model"
    if not test.join(seen, "record_id", "left_semi").isEmpty():
        raise ValueError("the model has seen test records")
    if provenance == "human_adjudicated_gold" and trained_on != manifest:
        raise ValueError("a model of gold annotations must be of this manifest")
    return "verified_manifest" if trained_on else "unverified_model_training_isolation"


def sealed(examples: DataFrame, assigned: DataFrame, seen: DataFrame | None = None, **known: str | None) -> tuple[str, DataFrame]:
    """(isolation status, the test records): examples joined to their assignment; none is an error."""
    test = examples.join(assigned.where("split = 'test'").select("record_id"), "record_id", "left_semi")
    if test.isEmpty():
        raise ValueError("the partition has no test records")
    return isolation(test, seen, **known), test


def measured(reports: DataFrame) -> DataFrame:
    """(name, label, f1, support) of the classes in reports (name, report JSON) that were measured; averages go."""
    each = "map<string,struct<`f1-score`:double,support:double>>"
    status, mode = F.get_json_object("report", "$.status"), F.get_json_object("report", "$.partition_mode")
    kept = reports.where((status == "measured") & mode.isNotNull()).select("name", F.explode(F.from_json(F.get_json_object("report", "$.test.per_class"), each)).alias("label", "v"))
    return kept.where(F.col("v.`f1-score`").isNotNull() & ~F.col("label").isin("macro avg", "weighted avg")).select("name", "label", F.col("v.`f1-score`").alias("f1"), F.col("v.support").alias("support"))


def summary_table(reports: DataFrame, rows: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(experiment, scope, metric, value) from reports (name, report JSON): rows name the experiment, its scope, the report and a JSON path."""
    asked = reports.sparkSession.createDataFrame([(e, s, n, p, i) for i, (e, s, n, p) in enumerate(rows)], "experiment string, scope string, name string, path string, place int")
    paths = sorted({p for _, _, _, p in rows})
    value = F.coalesce(*[F.when(F.col("path") == p, F.get_json_object("report", p)) for p in paths])
    return F.broadcast(asked).join(reports, "name", "left").select("place", "experiment", "scope", F.regexp_extract("path", r"([^.]+)$", 1).alias("metric"), value.cast("double").alias("value"))


TOLD = "struct<spans:array<struct<start:int,stop:int,label:string>>,seconds:double,failure:string>"


def compared(rows: DataFrame, extractors: Mapping[str, Callable[[Sequence[str]], Sequence[Sequence[tuple[int, int, str]]]]], text_col: str = "narrative") -> DataFrame:
    """(mode, record_id, format, spans, seconds, failure): what each plugged-in extractor makes of each record, how long it took, and how it failed.

    An extractor is asked about an Arrow batch of texts at a time; seconds are a record's share.
    If it fails, or gives another number of answers, the batch is asked again text by text, so a
    text that fails has no spans and its error, and costs no other record anything. A null text is
    asked about as an empty one. format is the suffix of source_document, in lower case.
    """

    def timed(extract) -> Column:
        @F.pandas_udf(TOLD)
        def run(texts: pd.Series) -> pd.DataFrame:
            asked = texts.fillna("").tolist()
            answer = lambda spans: [{"start": a, "stop": b, "label": label} for a, b, label in spans]

            def ask(some: list[str]) -> tuple[list, float]:
                began = time.perf_counter()
                found = [answer(x) for x in extract(some)]
                if len(found) != len(some):
                    raise ValueError(f"{len(found)} answers to {len(some)} texts")
                return found, (time.perf_counter() - began) / max(len(some), 1)

            try:
                found, each = ask(asked)
                told = [(x, each, None) for x in found]
            except Exception:  # which text it was is found by asking again
                told = []
                for text in asked:
                    began = time.perf_counter()
                    try:
                        told.append((ask([text])[0][0], time.perf_counter() - began, None))
                    except Exception as error:
                        told.append(([], time.perf_counter() - began, f"{type(error).__name__}: {error}"))
            return pd.DataFrame(told, columns=["spans", "seconds", "failure"])

        return run.asNondeterministic()(F.col(text_col))

    suffix = F.lower(F.regexp_extract("source_document", r"(\.[^./\\]+)$", 1)).alias("format") if "source_document" in rows.columns else F.lit("").alias("format")
    out = None
    for mode, extract in extractors.items():
        part = rows.select("record_id", suffix, timed(extract).alias("t")).select(F.lit(mode).alias("mode"), "record_id", "format", "t.*")
        out = part if out is None else out.unionByName(part)
    return out
