"""Advice from a table of papers: questions, the papers that answer them, the rate that they name, and how sure that is.

Papers are rows (title, url, abstract_snippet, citation_count, ...) of any table; a question is answered by the papers
that hold all of its rarer words. Nothing but one row of advice for each context has to leave Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rates that a text may name, citations that count as one paper's full strength, and the bounds of confidence.
LEAST_HZ, MOST_HZ, FULL_STRENGTH = 5, 400, 1500.0
TASK_RATE = {"human_activity_recognition": 50, "locomotion": 25}
PHRASES = {
    "human_activity_recognition": "human activity recognition", "gait_analysis": "gait analysis", "driving_behavior": "driving behavior", "health_monitoring": "health monitoring",
    "environmental_sensing": "environmental sensing", "free_living_monitoring": "free living monitoring", "locomotion": "locomotion tracking",
}
GENERAL = ("human activity recognition accelerometer gyroscope sampling rate", "sensor harmonization resampling strategy time series")
ENOUGH_PAPERS, TOP = 12, 5


def task_of(predicted: Column, modalities: Column, mean_rate: Column) -> Column:
    """The predicted task as a label with underscores; without one, by what was measured."""
    named = F.regexp_replace(F.regexp_replace(F.lower(F.trim(predicted)), "free-living", "free living"), " ", "_")
    moving = F.array_contains(modalities, "accelerometer") & F.array_contains(modalities, "gyroscope") & mean_rate.between(20, 100)
    guess = F.when(moving, "human_activity_recognition").when(F.array_contains(modalities, "gps"), "locomotion").otherwise("generic_imu")
    return F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(guess)


def questions(task: Column, modalities: Column) -> Column:
    """Up to six different questions for a task and its modalities, the most special one first."""
    names = F.array_join(F.array_sort(F.array_distinct(modalities)), " ")
    some = F.size(modalities) > 0
    phrase = F.lit("imu analysis")
    for label, words in PHRASES.items():
        phrase = F.when(task == label, words).otherwise(phrase)
    what = F.when(some, names).otherwise("imu sensor")
    special = F.concat_ws(" ", F.lit("smartphone"), F.when(some, names).otherwise("sensor"), F.lit("dataset sampling rate"), phrase)
    others = (F.concat_ws(" ", what, F.regexp_replace(task, "_", " "), F.lit("sampling rate dataset")), F.concat(what, F.lit(" sensor fusion time series alignment")), F.concat(what, F.lit(" wearable dataset harmonization")))
    return F.array_distinct(F.transform(F.array(special, *others, *map(F.lit, GENERAL)), lambda q: F.lower(F.trim(F.regexp_replace(q, r"\s+", " ")))))


def collected(answers: DataFrame, context: list[str], top: int = TOP) -> DataFrame:
    """context and papers: the most cited ``top`` of the answers (context, number of the question, paper).

    Questions count in their order until ``ENOUGH_PAPERS`` different papers are there; a paper is told by its url, or
    title, and comes with its greatest number of citations.
    """
    key = F.lower(F.trim(F.coalesce(F.col("url"), F.col("title"), F.lit(""))))
    rows = answers.withColumns({"_key": key, "citation_count": F.coalesce("citation_count", F.lit(0)).cast("long")}).where("_key <> ''")
    first = rows.groupBy(*context, "_key").agg(F.min("question").alias("first"))
    new = first.groupBy(*context, "first").agg(F.count(F.lit(1)).alias("new"))  # a row a question
    before = F.coalesce(F.sum("new").over(Window.partitionBy(*context).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = new.select(*context, F.col("first").alias("question"), (before < ENOUGH_PAPERS).alias("asked")).where("asked").groupBy(*context).agg(F.max("question").alias("last"))
    kept = rows.join(asked, context).where("question <= last").groupBy(*context, "_key").agg(F.max_by(F.struct("title", "url", "abstract_snippet", "citation_count"), F.struct("citation_count", -F.col("question"))).alias("p"))
    place = F.row_number().over(Window.partitionBy(*context).orderBy(F.desc("p.citation_count"), "_key"))
    best = kept.withColumn("_place", place).where(F.col("_place") <= top)
    return best.groupBy(*context).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "p"))), lambda x: x["p"]).alias("papers"))


def rates_in(text: Column) -> Column:
    """Whole rates that a text names, as numbers, sorted."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\b(\d{1,3})\s*hz\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.filter(found, lambda x: x.between(LEAST_HZ, MOST_HZ)))


def advised(rows: DataFrame) -> DataFrame:
    """``recommended_sampling_rate``, ``confidence`` and ``summary`` of rows with task, modalities, papers, fallback_rates.

    The rate: the upper median of those that the papers name, else the task's, else the mean of the measured ones, else 50.
    Without papers there is none, and no confidence.
    """
    named = rates_in(F.array_join(F.transform("papers", lambda p: F.coalesce(p["abstract_snippet"], F.lit(""))), " "))
    known = F.filter("fallback_rates", lambda r: r > 0)
    mean = F.aggregate(known, F.lit(0.0), lambda a, r: a + r) / F.size(known)
    other = F.when(F.size(known) > 0, F.bround(mean, 0).cast("int")).otherwise(50)
    for label, rate in TASK_RATE.items():
        other = F.when(F.col("task") == label, rate).otherwise(other)
    some = F.coalesce(F.size("papers") > 0, F.lit(False))
    rate = F.when(F.size(named) > 0, F.get(named, F.floor(F.size(named) / 2).cast("int"))).when(some, other)
    strength = F.aggregate("papers", F.lit(0.0), lambda a, p: a + F.least(F.lit(1.0), p["citation_count"] / FULL_STRENGTH)) / F.size("papers")
    rows = rows.withColumns({"recommended_sampling_rate": rate, "confidence": F.when(some, F.round(F.least(F.lit(0.95), 0.2 + F.least(F.lit(0.75), 0.75 * strength)), 2)).otherwise(0.0)})
    about = F.when(F.size("modalities") > 0, F.array_join("modalities", " + ")).otherwise("sensor")
    said = F.concat(F.lit("The most cited papers use ~"), F.col("recommended_sampling_rate").cast("string"), F.lit(" Hz for "), F.regexp_replace("task", "_", " "), F.lit(" with "), about, F.lit("."))
    return rows.withColumn("summary", F.when(some, said).otherwise("No relevant research found."))


def salvaged_json(text: Column, schema: str) -> Column:
    """The first JSON object of a text: what stands between its first and last brace; null without one."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def source_name(paper: Column) -> Column:
    """Of a nested record, with a default."""
    return F.coalesce(paper["primary_location"]["source"]["display_name"], F.lit("Unknown source"))
