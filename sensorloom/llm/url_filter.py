"""URL filter: host and path rules, and logistic regression on hashed character n-grams for all other URLs.

The classifier learns from a small labelled table (``data/url_labels.csv``, or a caller's own). Host and path are cut
into character n-grams with marks at their ends, hashed to ``buckets``, and fitted by Spark's own logistic
regression; scoring is a map over the pages. No Python runs on the rows.

Nulls: a null URL, or one without ``://``, has an empty host and path and no rule; the classifier still gives
it a verdict (that of its intercept). Repeated rows are judged each; of rules of one length the later in order of
host and path decides; empty tables give no rows; extra columns are dropped.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict); the longest that fits decides.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Weight of an allowed row: the table is balanced, a crawl is not, so without evidence a URL is allowed.
ALLOWED_WEIGHT = 3.0
#: The labelled table (url, block: 1 or 0): hosts of the kinds a crawl should leave out, against ordinary ones.
LABELLED_FILE = Path(__file__).parent / "data" / "url_labels.csv"


def labelled() -> list[tuple[str, int]]:
    with open(LABELLED_FILE, encoding="utf-8", newline="") as f:
        return [(r["url"], int(r["block"])) for r in csv.DictReader(f)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # a later, longer one wins
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def grams(sizes=(3, 4)) -> Column:
    """Character n-grams of host and path, each marked by where it is from."""

    def cut(mark: str, text: Column, n: int) -> Column:
        last = F.length(text) - n + 1
        found = F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n))))
        return F.when(last >= 1, found).otherwise(F.array().cast("array<string>"))

    host, path = F.concat(F.lit("^"), "host", F.lit("$")), F.concat("path", F.lit("$"))
    return F.concat(*(cut(mark, text, n) for mark, text in (("h", host), ("p", path)) for n in sizes))


def prepare(rows: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return rows.withColumn("host", host).withColumn("path", path).withColumn("grams", grams())


def train(spark: SparkSession, pairs: list[tuple[str, int]] | None = None, buckets: int = 1 << 14) -> PipelineModel:
    """The classifier, fitted on (url, 1 to block or 0) pairs; by default those of the labelled table."""
    weighted = [(u, float(y), 1.0 if y else ALLOWED_WEIGHT) for u, y in pairs or labelled()]
    rows = prepare(spark.createDataFrame(weighted, "url string, label double, weight double").coalesce(1))
    hashing = HashingTF(numFeatures=buckets, binary=True, inputCol="grams", outputCol="features")
    fit = LogisticRegression(maxIter=40, regParam=0.02, weightCol="weight", probabilityCol="probability").fit(hashing.transform(rows))
    return PipelineModel([hashing, fit])


def judge(pages: DataFrame, model: PipelineModel | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the classifier's probability to block) of every URL."""
    model = model or train(pages.sparkSession)
    scored = model.transform(prepare(pages.select("page_id", "url")))
    rule, verdict = rule_columns(rules)
    score = vector_to_array("probability")[1]
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
