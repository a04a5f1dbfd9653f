"""Configuration as input: terminology packs, mapping profiles, review histories, tables of other stores, saved models."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import snapshot
from gaugeline.operators.review import LABELS
from gaugeline.sources.readers import FIELDS

# Columns of the demo import.
DEMO_COLUMNS = {"vendor": "Company", "report_number": "ReportNumber", "report_date": "InspectionDate", "product": "Product", "batch": "Batch", "asset_id": "Asset"}
DEMO_TEXT = "Inspection"
# What a line of a review history must have.
REVIEW_KEYS = ("reviewed_at", "record_id", "domain", "corrected_entities", "note")


@dataclass(frozen=True)
class Terminology:
    """Validated packs in their order, and a version that changes with any of their bytes."""

    packs: Sequence[Mapping[str, Sequence[str]]] = field(default_factory=list)
    version: str = ""

    def table(self, spark: SparkSession) -> DataFrame:
        """(label, term, place): small by nature, so it can be broadcast."""
        rows = [(label, term.lower(), i) for i, pack in enumerate(self.packs) for label, terms in pack.items() for term in terms]
        return spark.createDataFrame(rows, "label string, term string, place int")


def _parse(name: str, content: str) -> object:
    if name.lower().endswith(".json"):
        return json.loads(content)
    try:
        import yaml  # optional
    except ImportError as e:
        raise RuntimeError("reading YAML needs an optional library; JSON packs need none") from e
    return yaml.safe_load(content)


def terminology(contents: Mapping[str, str]) -> Terminology:
    """Packs by file name: each needs a version and entities, a mapping of known labels to lists of terms."""
    packs, versions, digest = [], [], hashlib.sha256()
    for name, content in contents.items():
        digest.update(content.encode())
        pack = _parse(name, content)
        if not isinstance(pack, dict) or not isinstance(pack.get("entities"), dict) or not pack.get("version"):
            raise ValueError(f"{name} needs a version and entities")
        for label, terms in pack["entities"].items():
            if label not in LABELS or not isinstance(terms, list) or any(not isinstance(t, str) for t in terms):
                raise ValueError(f"{name} has an invalid label or terms: {label}")
        packs.append(pack["entities"])
        versions.append(str(pack["version"]))
    return Terminology(packs, "+".join(versions) + ":" + digest.hexdigest())


def load_terminology(spark: SparkSession, paths: Sequence[str]) -> Terminology:
    return terminology({p: snapshot.read_text(spark, p) for p in paths})


def load_profiles(spark: SparkSession, path: str) -> dict:
    """Mapping profiles by name; none if there is no file yet."""
    return json.loads(snapshot.read_text(spark, path)) if snapshot.exists(spark, path) else {}


def save_profile(spark: SparkSession, path: str, name: str, profile: Mapping[str, str]) -> None:
    """Add or replace a profile; the file is replaced in one step."""
    if not name.strip():
        raise ValueError("a profile needs a name")
    if set(profile) - set(FIELDS):
        raise ValueError(f"unknown metadata fields: {sorted(set(profile) - set(FIELDS))}")
    known = load_profiles(spark, path) | {name.strip(): dict(profile)}
    snapshot.replace_file(spark, path, json.dumps(known, indent=1, sort_keys=True))


def append_reviews(reviews: DataFrame, path: str) -> None:
    """Reviews as further JSON lines; what is there stays as it is."""
    reviews.write.mode("append").json(path)


def review_history(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, and the review's fields) by newest; none if nothing was written yet.

    A line that is no JSON or lacks a field fails the query with its number, which is the
    line's place in its file: files of a history are read whole, each by one task.
    """
    entities = "array<struct<label:string,start:int,stop:int,text:string,assertion:string>>"
    schema = f"reviewed_at string, record_id string, domain string, corrected_entities {entities}, note string"
    if not snapshot.exists(spark, path):
        return spark.createDataFrame([], f"file string, line int, {schema}")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "said")).where(F.trim("said") != "")
    keys = F.json_object_keys("said")
    bad = F.when(keys.isNull(), F.concat(F.lit("no JSON on line "), F.col("at") + 1)).when(F.size(F.array_except(F.array(*[F.lit(k) for k in REVIEW_KEYS]), keys)) > 0, F.concat(F.lit("an incomplete review on line "), F.col("at") + 1))
    checked = whole.withColumn("said", F.when(bad.isNotNull(), F.raise_error(F.concat("file", F.lit(": "), bad)).cast("string")).otherwise(F.col("said")))
    return checked.select("file", (F.col("at") + 1).alias("line"), F.from_json("said", schema).alias("r")).select("file", "line", "r.*").orderBy(F.desc("reviewed_at"))


def sqlite_table(spark: SparkSession, path: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table of a SQLite file, opened for reading only; a file is read by one task, in pages."""
    import sqlite3

    def connect():
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}
    con = connect()
    try:
        found = [(r[1], kinds.get((r[2] or "TEXT").upper(), "string")) for r in con.execute(f'pragma table_info("{table}")')]
    finally:
        con.close()
    if not found:
        raise ValueError(f"{path} has no table {table}")
    chosen = [(n, k) for n, k in found if columns is None or n in columns]

    def read(batches):
        import pandas as pd

        for _ in batches:
            con = connect()
            try:
                rows = con.execute("select " + ", ".join(f'"{n}"' for n, _ in chosen) + f' from "{table}"')
                while page := rows.fetchmany(5000):
                    yield pd.DataFrame(page, columns=[n for n, _ in chosen])
            finally:
                con.close()

    return spark.range(0, 1, 1, 1).mapInPandas(read, ", ".join(f"`{n}` {k}" for n, k in chosen))


def pasted(spark: SparkSession, text: str, domain: str = "general") -> DataFrame:
    """A text as if it were a file: one segment of pasted.txt; a blank one has none."""
    return spark.createDataFrame([("pasted.txt", 0, text, domain)], "path string, segment int, narrative string, domain string").where(F.trim("narrative") != "")


def demo_records(rows: DataFrame) -> DataFrame:
    """The demo table as canonical records, by its fixed columns."""
    from gaugeline.sources.readers import records

    return records(rows, DEMO_TEXT, DEMO_COLUMNS)


def load_model(spark: SparkSession, path: str, sha256: str | None = None):
    """A saved text classifier; with a checksum, only if the files are those it names."""
    from gaugeline.operators.classify import TextModel

    if sha256 is not None and snapshot.fingerprint(spark, path) != sha256:
        raise ValueError(f"the model at {path} is not the one that was asked for")
    return TextModel.load(spark, path)


def save_model(model, path: str, about: Mapping[str, object]) -> dict:
    """A model and what is known of it at a new place; an existing one is refused. Returns that with the model's checksum."""
    from pyspark.sql import SparkSession as S

    spark = S.active()
    if snapshot.exists(spark, path):
        raise FileExistsError(f"{path} has a model")
    model.save(f"{path}/model")
    told = {**about, "sha256": snapshot.fingerprint(spark, f"{path}/model")}
    snapshot.write_new(spark, f"{path}/metadata.json", json.dumps(told, sort_keys=True, indent=1))
    return told
