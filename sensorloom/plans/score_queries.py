"""Named queries of distribution, completeness and research scores, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom import registry
from sensorloom.operators import distributions, research
from sensorloom.plans.agent_queries import TWO, two_datasets
from sensorloom.plans.queries import IMU, query, rounded
from sensorloom.sources import tables as S

THREE = ["acc_x1", "acc_y1", "gyro_z2"]


def bins_of(keys: str, bins: int, least: int, ends: str) -> str:
    """SQL: shares ``p`` by (keys, c, bin) of the columns in ``u``; ``ends``: keys and limits of a column's bins."""
    group = f"{keys}, c" if keys else "c"
    on = f"using ({group})" if ends == "own" else "using (c)"
    limits = f"select {group}, min(v) lo, max(v) hi from u group by all" if ends == "own" else "select c, min(v) lo, max(v) hi from u group by all"
    return (
        f"select {group}, bin, (coalesce(n, 0) / (total * (hi - lo) / {bins}) + 1e-8) / sum(coalesce(n, 0) / (total * (hi - lo) / {bins}) + 1e-8) over (partition by {group}) p"
        f" from (select {group}, lo, hi, count(*) total from u join ({limits}) {on} group by all having count(*) >= {least}) cross join (select unnest(range({bins})) bin)"
        f" left join (select {group}, least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1})::int bin, count(*) n from u join ({limits}) {on} group by all) using ({group}, bin)"
    )


LONG = "u as (unpivot (select label % 4 grp, " + ", ".join(THREE) + " from imu) on " + ", ".join(THREE) + " into name c value v)"


@query(f"""with {IMU}, {LONG}, p as ({bins_of("grp", 50, 50, "own")}), j as (select grp, c, 0.5 * sum(p * ln(2 * p / (p + 0.02))) + 0.5 * sum(0.02 * ln(0.04 / (p + 0.02))) js from p group by all)
 select grp, c column_name, round(1 - js, 6) similarity from j""")
def js_against_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How evenly the values of each column are spread over 50 bins."""
    rows = S.imu(spark, sf_dir).withColumn("grp", F.col("label") % 4)
    return rounded(distributions.against_uniform(rows, ["grp"], THREE), 6, "similarity")


@query(f"""with {IMU}, {LONG}, p as ({bins_of("grp", 30, 30, "all")}), q as (select c, bin, p q from ({bins_of("", 30, 30, "all")})),
 j as (select grp, c, sqrt(greatest(0.0, 0.5 * sum(p * ln(2 * p / (p + q))) + 0.5 * sum(q * ln(2 * q / (p + q))))) d from p join q using (c, bin) group by all) select grp, c column_name, round(1 - d, 6) similarity from j""")
def js_against_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's distribution of a column against that of all rows."""
    rows = S.imu(spark, sf_dir).withColumn("grp", F.col("label") % 4)
    return rounded(distributions.against_all(rows, ["grp"], THREE), 6, "similarity")


REST = sum(w for m, (_, w, _) in registry.MODALITIES.items() if m not in ("accelerometer", "gyroscope", "barometer"))
FULL = lambda names: "(" + " + ".join(f"avg(({c} is not null)::int)" for c in names) + f") / {len(names)}"


@query(f"""with {TWO}, g as (select *, (pos - lag(pos) over (partition by participant_id, dataset_id order by pos)) / 4.0 gap from two)
 select participant_id, dataset_id, round({REST} + 0.25 * {FULL(["acc_x", "acc_y", "acc_z"])} + 0.20 * {FULL(["gyro_x", "gyro_y", "gyro_z"])} + 0.10 * avg((pressure is not null)::int), 6) completeness, round(coalesce(1 / (1 + stddev_samp(gap)), 0.5), 6) regularity,
 round(0.8 * ({REST} + 0.25 * {FULL(["acc_x", "acc_y", "acc_z"])} + 0.20 * {FULL(["gyro_x", "gyro_y", "gyro_z"])} + 0.10 * avg((pressure is not null)::int)) + 0.2 * coalesce(1 / (1 + stddev_samp(gap)), 0.5), 4) score from g group by all""")
def modality_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness weighted by modality, and how regular the samples come."""
    rows = two_datasets(spark, sf_dir).withColumn("ts", F.timestamp_millis(F.col("pos") * 250))
    return rounded(distributions.by_modality(rows, ["participant_id", "dataset_id"]), 6, "completeness", "regularity")


@query("""with w as (select doc_id, lang, source, n_chars, 'paper ' || (doc_id % 300) title, 'sampled at ' || (doc_id % 450) || ' Hz and ' || (doc_id % 7) || 'hz' abstract, doc_id % 6 question from documents),
 a as (select lang, question, title, n_chars % 2000 citations, abstract from w), f as (select lang, title, min(question) first from a group by all), n as (select lang, first question, count(*) new from f group by all),
 b as (select *, coalesce(sum(new) over (partition by lang order by question rows between unbounded preceding and 1 preceding), 0) before from n), l as (select lang, max(question) last from b where before < 12 group by 1),
 k as (select lang, title, max(citations) citations, arg_max(abstract, citations * 100 - question) abstract from a join l using (lang) where question <= last group by all),
 r as (select *, row_number() over (partition by lang order by citations desc, title) rn from k), t as (select * from r where rn <= 5),
 z as (select lang, list_sort(list(hz)) hz from (select lang, unnest(regexp_extract_all(lower(abstract), '\\b(\\d{1,3})\\s*hz\\b', 1))::int hz from t) where hz between 5 and 400 group by 1),
 s as (select lang, count(*) papers, avg(least(1.0, citations / 1500.0)) strength from t group by 1)
 select lang, papers, coalesce(hz[len(hz) // 2 + 1], 50)::int recommended_sampling_rate, round(least(0.95, 0.2 + least(0.75, 0.75 * strength)), 2) confidence from s left join z using (lang)""")
def research_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice for every language as a context; documents stand for answers to six questions, with repeated papers."""
    d = S.table(spark, sf_dir, "documents")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    number = lambda n: (F.col("doc_id") % n).cast("string")
    answers = d.select("lang", (F.col("doc_id") % 6).alias("question"), text("paper ", number(300)).alias("title"), F.lit(None).cast("string").alias("url"), text("sampled at ", number(450), " Hz and ", number(7), "hz").alias("abstract_snippet"), (F.col("n_chars") % 2000).alias("citation_count"))
    found = research.collected(answers, ["lang"])
    rows = found.withColumns({"task": F.lit("human_activity_recognition"), "modalities": F.array(F.lit("accelerometer")), "fallback_rates": F.array().cast("array<double>")})
    return research.advised(rows).select("lang", F.size("papers").cast("long").alias("papers"), "recommended_sampling_rate", "confidence")


@query("""with r as (select user_id, avg(value) rate from events group by 1), t as (select user_id, case when user_id % 3 = 0 then ['accelerometer', 'gyroscope'] when user_id % 3 = 1 then ['gps'] else [] end m, rate, case when user_id % 5 = 0 then 'Free-living Monitoring' end predicted from r),
 k as (select *, case when predicted is not null then 'free_living_monitoring' when len(m) = 2 and rate between 20 and 100 then 'human_activity_recognition' when list_contains(m, 'gps') then 'locomotion' else 'generic_imu' end task from t)
 select user_id, task, 'smartphone ' || case when len(m) > 0 then array_to_string(m, ' ') else 'sensor' end || ' dataset sampling rate ' || case task when 'free_living_monitoring' then 'free living monitoring' when 'human_activity_recognition' then 'human activity recognition' when 'locomotion' then 'locomotion tracking' else 'imu analysis' end question, 6::int questions from k""")
def research_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task of every user and the questions that are asked for it."""
    u = F.col("user_id")
    rows = S.table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("rate"))
    m = F.when(u % 3 == 0, F.array(F.lit("accelerometer"), F.lit("gyroscope"))).when(u % 3 == 1, F.array(F.lit("gps"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"m": m, "predicted": F.when(u % 5 == 0, "Free-living Monitoring")})
    rows = rows.withColumn("task", research.task_of(F.col("predicted"), F.col("m"), F.col("rate")))
    q = research.questions(F.col("task"), F.col("m"))
    return rows.select("user_id", "task", q[0].alias("question"), F.size(q).alias("questions"))


