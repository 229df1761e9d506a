"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Everything is DataFrame work. One pass over the texts gives a small table of statistics. A document fails the
base rule if it has fewer than ``min_words`` words or if more than ``max_repeat_percent`` of them lie in
8-word windows that the text repeats. The rest are judged by a vector of transformed statistics:

1. starts: median and scaled median deviation of each statistic, and plain mean and covariance, give first
   distances per document;
2. concentration steps from each: the ``coverage`` share of least distance gives a mean and covariance, those give
   new distances, and so on until no determinant falls; of the two ends, a group takes that of less determinant.
   Covariances carry a variance floor, as most documents have no symbols at all;
3. the last distances are scaled so that their median is not above the chi-square median;
4. a document is rejected if its squared distance exceeds the chi-square value of probability ``chance``.

Estimates are one row per (language, source) with ``min_group`` documents that pass the base rule (ten for each
statistic); smaller groups share their language's estimate, small languages that of all documents. If even those
are fewer than ``min_group``, nothing is rejected beyond the base rule. Quantiles are Spark's mergeable sketches and
moments are sums, so a source with a third of all rows is combined on the map side like any other.

Nulls: a null text has no words; null language and source are values of their own; a null doc_id is returned as
it is. Repeated rows are judged each; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import shared

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Statistic: standard deviation added to every estimate, in transformed units.
FLOORS = {"x_symbols": 0.15, "x_word_length": 0.25, "x_dup_lines": 0.10, "x_repeats": 0.08, "x_capitals": 0.08, "x_shouts": 0.08}
NAMES = tuple(FLOORS)
#: Median of the chi-square distribution with six degrees of freedom.
CHI2_MEDIAN = 5.348


def without(text: Column, characters: str) -> Column:
    """Length of the text without these characters."""
    return F.length(F.translate(text, characters, ""))


def base_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and letter counts of the whole text.

    Equal windows are found by sorting their 64-bit hashes with their places, within the row.
    """
    rows = docs.select(*keep, shared.text_or_empty().alias("t"))
    flat = F.trim(F.regexp_replace("t", SPACE + "+", " "))
    rows = rows.withColumn("flat", flat).withColumn("words", F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " ", -1)))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *keep, "t", F.transform("words", lambda x: F.xxhash64(x)).alias("w"), F.size("words").cast("long").alias("n_words"), (F.length("flat") - F.size("words") + 1).alias("inner"), lines.alias("lines"),
    )
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(1), (F.col("n_words") - WINDOW + 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("h", F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, WINDOW))))
    # Sorted with their places only where some hash occurs twice.
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("pairs", pairs)
    twice = F.filter("pairs", lambda x, k: (F.get("pairs", k - 1)["h"] == x["h"]) | F.coalesce(F.get("pairs", k + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(
        *keep, "n_words", F.when(F.col("n_words") == 0, 0).otherwise(F.col("inner")).cast("long").alias("word_chars"),
        (F.length("t") - without(F.col("t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), F.size("lines").alias("n_lines"),
        (F.length("t") - without(F.col("t"), CAPITALS)).alias("n_capitals"), (F.length("t") - without(F.col("t"), "!?")).alias("n_shouts"),
    )


def with_vector(stats: DataFrame, prior: int = 20) -> DataFrame:
    """The transformed statistics: shrunk rates (``prior`` words without any), in inverse-hyperbolic-sine scale."""
    n = F.col("n_words") + prior
    return stats.withColumns({
        "x_symbols": F.asinh(F.col("n_symbols") / n * 4),
        "x_word_length": (F.col("word_chars") + 5 * prior) / n,
        "x_dup_lines": F.asinh(F.col("n_dup_lines") / (F.col("n_lines") + 5) * 2),
        "x_repeats": F.asinh(F.col("n_repeat_words") / n * 2),
        "x_capitals": F.asinh(F.col("n_capitals") / (F.col("word_chars") + 5 * prior) * 4),
        "x_shouts": F.asinh(F.col("n_shouts") / n * 4),
    })


#: Groups up to which their estimates are broadcast: some 300 bytes each. Beyond it they are joined by key.
BROADCAST_GROUPS = 20_000


def by_key(rows: DataFrame, estimates: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with the estimates (a stored table, one row a group) of their group.

    Estimates of few groups are broadcast. More are joined by sorting, where a large group can be split, as the
    estimates come from a table.
    """
    small = estimates.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(estimates) if small else estimates.hint("merge"), key, "left")


def with_group(rows: DataFrame, min_group: int) -> DataFrame:
    """``key``: the smallest of (language, source), language or everything that has ``min_group`` usable rows; else null.

    One aggregation by (language, source); the larger groups are sums over its few rows.
    """
    text = lambda *names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    rows = rows.withColumn("fine", text("lang", "source"))
    sizes = rows.groupBy("fine", text("lang").alias("coarse")).agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    sizes = shared.stored(sizes, "group-sizes")
    coarse = sizes.groupBy("coarse").agg(F.sum("n").alias("n_coarse"))
    everything = sizes.agg(F.sum("n")).head()[0] or 0
    keys = sizes.join(coarse, "coarse").select("fine", F.when(F.col("n") >= min_group, F.col("fine")).when(F.col("n_coarse") >= min_group, F.col("coarse")).when(F.lit(everything >= min_group), "all").alias("key"))
    return by_key(rows, shared.stored(keys, "group-keys"), "fine").drop("fine")


def squared(parts: list[Column]) -> Column:
    return reduce(add, [p * p for p in parts])


def chi_square_quantile(above: float) -> float:
    """The value that a chi-square variable of six degrees of freedom exceeds with probability ``above``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 4  # half the middle
        low, high = (2 * x, high) if math.exp(-x) * (1 + x + x * x / 2) > above else (low, 2 * x)
    return low


def usable(rows: DataFrame) -> DataFrame:
    return rows.where("key is not null and not base_failed")


def first_distance(rows: DataFrame) -> DataFrame:
    """``d2``: distances by median and scaled median deviation of each statistic alone."""
    used = usable(rows)
    mid = shared.stored(used.groupBy("key").agg(*(F.percentile_approx(x, 0.5, 2000).alias("m_" + x) for x in NAMES)), "medians")
    off = by_key(used, mid).groupBy("key").agg(*(F.percentile_approx(F.abs(F.col(x) - F.col("m_" + x)), 0.5, 2000).alias("s_" + x) for x in NAMES))
    stats = shared.stored(mid.join(off, "key"), "mcd-start")
    parts = [(F.col(x) - F.col("m_" + x)) / F.greatest(F.col("s_" + x) * 1.4826, F.lit(FLOORS[x])) for x in NAMES]
    return by_key(rows, stats).withColumn("d2", squared(parts)).select(*rows.columns, "d2")


def distance(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """``d2``: squared Mahalanobis distances, by forward substitution through the Cholesky factor of the row's group."""
    out = by_key(rows, factors)
    for i, x in enumerate(NAMES):
        known = reduce(add, [F.col(f"l_{i}_{j}") * F.col(f"y_{j}") for j in range(i)], F.lit(0.0))
        out = out.withColumn(f"y_{i}", (F.col(x) - F.col("m_" + x) - known) / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", squared([F.col(f"y_{i}") for i in range(len(NAMES))]) / F.col("scale")).select(*rows.columns, "d2")


def factors(near: DataFrame, coverage: float) -> DataFrame:
    """Mean, Cholesky factor and ``log_det`` of each group's ``coverage`` share of least distance (``near``: rows with d2)."""
    used = usable(near)
    if coverage < 1:
        limit = shared.stored(used.groupBy("key").agg(F.percentile_approx("d2", coverage, 2000).alias("limit")), "mcd-limits")
        used = by_key(used, limit).where(F.col("d2") <= F.col("limit"))
    pairs = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]
    out = used.groupBy("key").agg(*(F.avg(x).alias("m_" + x) for x in NAMES), *(F.covar_pop(NAMES[i], NAMES[j]).alias(f"c_{i}_{j}") for i, j in pairs))
    for i, j in pairs:
        known = reduce(add, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.lit(0.0))
        rest = F.col(f"c_{i}_{j}") - known
        out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(0.0)) + FLOORS[NAMES[i]] ** 2) if i == j else rest / F.col(f"l_{j}_{j}"))
    log_det = reduce(add, [F.log(F.col(f"l_{i}_{i}")) for i in range(len(NAMES))]) * 2
    return shared.stored(out.select("key", *("m_" + x for x in NAMES), *(f"l_{i}_{j}" for i, j in pairs), F.lit(1.0).alias("scale"), log_det.alias("log_det")), "mcd-factors")


def least_determinant(rows: DataFrame, coverage: float, steps: int) -> DataFrame:
    """The estimates of each group by concentration steps from two starts, those of less determinant.

    Starts: distances by medians, and by plain mean and covariance of all rows. Steps are repeated until the
    determinant of no group falls by more than a thousandth, at most ``steps`` times.
    """
    ends = []
    for start in (first_distance(rows), distance(rows, factors(rows.withColumn("d2", F.lit(0.0)), 1.0))):
        fitted = factors(start, coverage)
        for _ in range(steps - 1):
            new = factors(distance(rows, fitted), coverage)
            falls = new.select("key", F.col("log_det").alias("now")).join(fitted.select("key", "log_det"), "key").where("now < log_det - 0.001")
            fitted = new
            if falls.isEmpty():
                break
        ends.append(fitted)
    a, b = ends
    other = b.select("key", F.struct(*(F.col(c) for c in b.columns if c != "key")).alias("b"))
    both = a.select("key", F.struct(*(F.col(c) for c in a.columns if c != "key")).alias("a")).join(other, "key")
    best = both.select("key", F.when(F.col("b.log_det") < F.col("a.log_det"), F.col("b")).otherwise(F.col("a")).alias("best"))
    return shared.stored(best.select("key", "best.*"), "mcd-best")


def judge(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, coverage: float = 0.75, steps: int = 6, chance: float = 5e-8, min_group: int = 60) -> DataFrame:
    """doc_id, the base statistics, ``base_failed``, ``d2`` (null where not judged) and ``kept``; one row per document.

    ``chance``: how likely a document of a Gaussian group would be rejected; with 5e-8, one in twenty million.
    """
    stats = with_vector(base_statistics(docs, "doc_id", "lang", "source"))
    stats = stats.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    rows = shared.stored(with_group(shared.stored(stats, "quality"), min_group), "quality-keys")
    fitted = least_determinant(rows, coverage, steps)
    near = distance(rows, fitted)
    middle = usable(near).groupBy("key").agg(F.greatest(F.lit(1.0), F.percentile_approx("d2", 0.5, 2000) / CHI2_MEDIAN).alias("scale"))
    near = distance(rows, shared.stored(fitted.drop("scale").join(middle, "key"), "mcd-scaled"))
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= chi_square_quantile(chance)))
    return near.withColumn("kept", kept)


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """The documents that ``judge`` keeps, all columns as they came.

    Rows with equal doc_id share the strictest verdict, and so do rows without one that have the same text.
    """
    keyed = docs.select(shared.row_key().alias("doc_id"), "text", "lang", "source")
    bad = judge(keyed, **settings).where(~F.col("kept")).select(F.col("doc_id").alias("__bad_id")).distinct()
    return docs.join(bad, shared.row_key() == F.col("__bad_id"), "left_anti")
