"""Benchmark scenarios: folders of two to four datasets with what is known of them, as one keyed frame."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.registry import CHANNELS, HarmonizeError
from sensorloom.sources import ingest

METADATA = "ground_truth_offsets_seconds map<string, double>, ground_truth_offset_seconds double, best_alignment_strategy string"
DATASET, MOST_DATASETS = re.compile(r"[^/]+/dataset[^/]*\.csv", re.I), 4


@dataclass
class Scenarios:
    """``frame``: participant_id (the scenario), dataset_id, ts, channels. ``truth``: scenario, ground_truth_offsets_seconds,
    ground_truth_offset_seconds and best_alignment_strategy, nulls where nothing is known."""

    frame: DataFrame
    truth: DataFrame

    def slots(self) -> list[DataFrame]:
        """The k-th dataset of every scenario, for each k."""
        return [self.frame.where(F.col("dataset_id") == f"dataset{k}") for k in range(1, MOST_DATASETS + 1)]


def salvaged(text, schema: str):
    """A JSON object of a text: the whole text, or what stands between its first and last brace."""
    return F.coalesce(F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema))


def load_scenarios(spark: SparkSession, root: str, most_files: int = 1000) -> Scenarios | None:
    """Every folder right below ``root`` with two dataset*.csv or more, in order of their names; None without any.

    ``metadata.json`` beside them is read if it is there, and passed over if it is no JSON object. Files of one header
    are one scan, whatever their scenario.
    """
    try:
        rows = ingest.listed(spark, root, "csv").limit(most_files + 1).collect()
    except HarmonizeError:
        return None
    if len(rows) > most_files:
        raise HarmonizeError("too_many_files", f"more than {most_files} files below {root}")
    by: dict[str, list[ingest.File]] = {}
    for f in sorted(ingest.File(r.rel, r.path, r.key) for r in rows if DATASET.fullmatch(r.rel)):
        by.setdefault(posixpath.dirname(f.rel), []).append(f)
    by = {name: files[:MOST_DATASETS] for name, files in by.items() if len(files) > 1}
    if not by:
        return None
    places = {f: (name, f"dataset{k}") for name, files in by.items() for k, f in enumerate(files, 1)}
    files = list(places)
    read = ingest.headers(spark, files)
    groups: dict[tuple, list[ingest.File]] = {}
    for f in files:
        groups.setdefault(tuple(read[f].names), []).append(f)
    frame = None
    for names, members in groups.items():
        part, _ = ingest.canonical_frames(spark, members, list(names), {f: read[f].open_quotes for f in members})
        facts = spark.createDataFrame([(f.key, *places[f]) for f in members], "_file string, participant_id string, dataset_id string")
        part = part.join(F.broadcast(facts), "_file").drop("_file")  # at most ``most_files`` rows
        frame = part if frame is None else frame.unionByName(part, allowMissingColumns=True)
    channels = [c for c in CHANNELS if c in frame.columns]
    from sensorloom.operators.resample import first_known

    frame = first_known(frame, ["participant_id", "dataset_id", "ts"], channels, ["_block", "_id"])
    return Scenarios(frame, truth_of(spark, root, list(by)))


def truth_of(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    all_of_them = spark.createDataFrame([(n,) for n in names], "scenario string")
    found = ingest.listed(spark, root, "json").where(F.col("rel").rlike(r"^[^/]+/metadata\.json$"))
    paths = [r.path for r in found.collect()]  # one a scenario
    if not paths:
        return all_of_them.select("scenario", F.from_json(F.lit(None).cast("string"), METADATA).alias("_m")).select("scenario", "_m.*")
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("key"), salvaged(F.col("value"), METADATA).alias("_m"))
    named = found.select("key", F.split_part("rel", F.lit("/"), F.lit(1)).alias("scenario")).join(texts, "key")
    return all_of_them.join(named, "scenario", "left").select("scenario", "_m.*")
