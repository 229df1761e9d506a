"""Named queries of the harmonisation operators over the test tables, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom import registry
from sensorloom.functions import columns as C
from sensorloom.operators import decisions, rates, resample, signals
from sensorloom.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


EVENTS = "ev as (select user_id participant_id, event_type dataset_id, ts, value, event_id from events)"
IMU = "imu as (select vec_id pos, label, " + ", ".join(f"embedding[{i + 1}]::double {s}_{a}{d}" for i, (d, s, a) in enumerate((d, s, a) for d in (1, 2) for s in ("acc", "gyro") for a in "xyz")) + " from embeddings)"
PAIR = IMU + ", pair as (select pos, sqrt(acc_x1*acc_x1+acc_y1*acc_y1+acc_z1*acc_z1) x, sqrt(acc_x2*acc_x2+acc_y2*acc_y2+acc_z2*acc_z2) y from imu)"
HOURLY = EVENTS + ", h as (select dataset_id, time_bucket(interval 1 hour, ts) ts, avg(value) value from ev where dataset_id in ('click','purchase') group by all)"
GRID = HOURLY + ", o as (select max(lo) lo, min(hi) hi from (select min(ts) lo, max(ts) hi from h group by dataset_id)), g as (select unnest(generate_series(lo, hi, interval 1 hour)) ts from o), d as (select distinct dataset_id from h), r as (select d.dataset_id, g.ts, h.value from g cross join d left join h on h.ts = g.ts and h.dataset_id = d.dataset_id)"
LINEAR = GRID + """, k as (select *, last_value(case when value is not null then struct_pack(t := epoch_us(ts)/1e6, v := value) end ignore nulls) over w1 p,
 first_value(case when value is not null then struct_pack(t := epoch_us(ts)/1e6, v := value) end ignore nulls) over w2 n from r
 window w1 as (partition by dataset_id order by ts rows between unbounded preceding and current row), w2 as (partition by dataset_id order by ts rows between current row and unbounded following)),
 i as (select dataset_id, ts, coalesce(value, p.v + (n.v - p.v) / nullif(n.t - p.t, 0) * (epoch_us(ts)/1e6 - p.t), p.v) value from k)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bucket_mean(S.events(spark, sf_dir).where("dataset_id in ('click', 'purchase')"), ["dataset_id"], "value", "1 hour")


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = hourly(spark, sf_dir)
    span = rates.overlap(samples, "dataset_id", [])
    points = resample.grid(span, [], "1 hour").crossJoin(F.broadcast(samples.select("dataset_id").distinct()))  # two dataset names
    return resample.on_grid(points, samples, ["dataset_id"])


@query(f"with {LINEAR} select ts, round(avg(value), 6) fused_value, count(dataset_id) n_datasets from i group by ts")
def resample_fuse_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = gridded(spark, sf_dir).withColumn("value", resample.interpolated("value", ["dataset_id"]))
    return resample.fused(filled, [], ["value"]).select("ts", F.round("value", 6).alias("fused_value"), "n_datasets")


@query(f"with {LINEAR} select dataset_id, ts, round(value, 6) as value from i")
def interpolate_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gridded(spark, sf_dir).withColumn("value", resample.interpolated("value", ["dataset_id"])), 6, "value").select("dataset_id", "ts", "value")


@query(f"with {GRID} select dataset_id, ts, round(last_value(value ignore nulls) over (partition by dataset_id order by ts rows between unbounded preceding and current row), 6) as value from r")
def ffill_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gridded(spark, sf_dir).withColumn("value", resample.forward_filled("value", ["dataset_id"])), 6, "value").select("dataset_id", "ts", "value")


RATES = f"with {EVENTS}, gaps as (select dataset_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by dataset_id order by ts)))/1e6 gap from ev), m as (select dataset_id, median(gap) g, count(*) n from gaps group by 1)"


@query(RATES + " select dataset_id, coalesce(round(case when g > 0 then 1/g end, 2), 1.0) rate_hz, n from m")
def sampling_rate_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.sampling_rate(S.events(spark, sf_dir), ["dataset_id"])


@query(RATES + " select dataset_id, round(coalesce(case when g > 0 then 1/g end, 0.0), 9) rate_hz, n from m")
def sampling_rate_unrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rates.sampling_rate(S.events(spark, sf_dir), ["dataset_id"], digits=None, default=0.0), 9, "rate_hz")


@query(RATES + ", r as (select coalesce(round(case when g > 0 then 1/g end, 4), 1.0) rate_hz from m) select coalesce(min(case when rate_hz > 0 then rate_hz end), 10.0) master_rate_hz, stddev_pop(rate_hz) > greatest(0.05, 0.15 * coalesce(min(case when rate_hz > 0 then rate_hz end), 10.0)) rate_drift from r")
def master_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rates.sampling_rate(S.events(spark, sf_dir), ["dataset_id"], digits=4)
    least = F.coalesce(F.min(F.when(F.col("rate_hz") > 0, F.col("rate_hz"))), F.lit(10.0))
    return r.agg(least.alias("master_rate_hz"), (F.stddev_pop("rate_hz") > F.greatest(F.lit(0.05), 0.15 * least)).alias("rate_drift"))


@query(f"with {EVENTS}, d as (select participant_id, dataset_id, min(ts) lo, max(ts) hi from ev group by all), o as (select participant_id, max(lo) lo, min(hi) hi from d group by 1) select participant_id, case when lo < hi then lo end overlap_start, case when lo < hi then hi end overlap_end, case when lo < hi then round((epoch_us(hi) - epoch_us(lo))/1e6, 3) else 0.0 end duration_seconds from o")
def duration_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.overlap(S.events(spark, sf_dir), "dataset_id", ["participant_id"])


@query("with s as (unpivot (select l_returnflag, l_quantity, l_extendedprice, l_discount from lineitem) on l_quantity, l_extendedprice, l_discount into name column_name value v) select l_returnflag, column_name, 0.0::double missing_ratio, round(avg(v), 6) mean_value, round(stddev_samp(v), 6) std_value, min(v) min_value, max(v) max_value from s group by all")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.column_profile(S.table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"])


@query(f"with {EVENTS}, g as (select dataset_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by dataset_id order by ts)))/1e6 gap from ev), m as (select dataset_id, median(gap) md from g group by 1) select dataset_id, bool_and(abs(gap - md) < 0.2 * md) continuous, round(1/(1+var_pop(gap)), 9) sampling_consistency, round(1/(1+stddev_samp(gap)), 9) temporal_consistency from g join m using (dataset_id) where gap is not null group by 1")
def time_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rates.continuity(S.events(spark, sf_dir), ["dataset_id"]), 9, "sampling_consistency", "temporal_consistency")


MODALITY_ROWS = ", ".join(f"('{m}', {w}, {str(m in ('accelerometer', 'heart_rate')).lower()})" for m, (_, w, _) in registry.MODALITIES.items())


@query(f"with m(modality, weight, present) as (values {MODALITY_ROWS}), r as (select avg((value is null)::double) acc, avg((event_type <> 'purchase')::double) hr from events), x as (select modality, weight, present, case modality when 'accelerometer' then acc when 'heart_rate' then hr else 1.0 end miss from m cross join r) select round(sum(weight::double * miss) / (sum(weight::double) + 1e-9), 6) missingness_penalty, round(sum(case when present then weight::double else 0 end) / (sum(weight::double) + 1e-9), 6) sensor_coverage from x")
def modality_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as an acceleration channel, those of purchases as heart rate: weighted missingness and coverage."""
    wide = S.events(spark, sf_dir).select(F.col("value").alias("acc_x"), F.when(F.col("dataset_id") == "purchase", F.coalesce("value", F.lit(0.0))).alias("heart_rate"))
    have = set(wide.columns)
    total = sum(w for _, w, _ in registry.MODALITIES.values()) + 1e-9
    missing, covered = F.lit(0.0), 0.0
    for names, weight, _ in registry.MODALITIES.values():
        used = [c for c in names if c in have]
        share = sum((F.avg(F.col(c).isNull().cast("double")) for c in used), F.lit(0.0)) / len(used) if used else F.lit(1.0)
        missing, covered = missing + weight * share, covered + weight * bool(used)
    return wide.agg(F.round(missing / total, 6).alias("missingness_penalty"), F.round(F.lit(covered / total), 6).alias("sensor_coverage"))


@query(f"with {EVENTS} select participant_id, date_trunc('day', ts) as day, min_by(value, struct_pack(a := dataset_id, b := event_id)) filter (where value > 50) high, min_by(value, struct_pack(a := dataset_id, b := event_id)) as value from ev group by all")
def combine_first_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.events(spark, sf_dir).select("participant_id", F.date_trunc("day", "ts").alias("day"), F.when(F.col("value") > 50, F.col("value")).alias("high"), "value", "dataset_id", "event_id")
    return resample.first_known(rows, ["participant_id", "day"], ["high", "value"], ["dataset_id", "event_id"])


@query(f"""with {EVENTS}, l as (select * from ev where dataset_id = 'click'), r as (select participant_id, ts, avg(value) as value from ev where dataset_id = 'view' group by all),
 c as (select l.event_id, r.value, r.ts matched_ts, row_number() over (partition by l.event_id order by abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts) rn from l join r on l.participant_id = r.participant_id and abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 86400000000)
 select l.event_id, l.participant_id, l.ts, round(c.value, 6) as value, c.matched_ts from l left join c on c.event_id = l.event_id and c.rn = 1""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.events(spark, sf_dir)
    right = e.where("dataset_id = 'view'").groupBy("participant_id", "ts").agg(F.avg("value").alias("value"))
    left = e.where("dataset_id = 'click'").select("event_id", "participant_id", "ts")
    return rounded(resample.asof_nearest(left, right, ["participant_id"], "value", 86400.0), 6, "value")


@query(f"with {EVENTS} select dataset_id, count(distinct participant_id) n_participants, count(*) n_rows from ev where participant_id in (select participant_id from ev group by 1 having count(distinct dataset_id) >= 2) group by 1")
def participants_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.events(spark, sf_dir)
    both = e.select("participant_id", "dataset_id").distinct().groupBy("participant_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return e.join(both, "participant_id", "left_semi").groupBy("dataset_id").agg(F.countDistinct("participant_id").alias("n_participants"), F.count(F.lit(1)).alias("n_rows"))


@query(f"with {IMU}, s as (" + " union all ".join(f"select '{c}' c, {c}1 a, {c}2 b from imu" for c in ("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z")) + "), p as (select c, least(1.0, abs(avg(a) - avg(b)) / (stddev_pop(a) + stddev_pop(b) + 1e-9) / 3) s from s where a is not null and b is not null group by c having count(*) >= 3) select round(avg(s), 4) divergence from p")
def dataset_pairs_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z")
    rows = S.imu(spark, sf_dir).select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c + "1").alias("a"), F.col(c + "2").alias("b")) for c in names))).alias("s")).select("s.*").where("a is not null and b is not null")
    gap = F.abs(F.avg("a") - F.avg("b")) / (F.stddev_pop("a") + F.stddev_pop("b") + 1e-9)
    return rows.groupBy("c").agg(F.least(F.lit(1.0), gap / 3).alias("s"), F.count(F.lit(1)).alias("n")).where("n >= 3").agg(F.round(F.avg("s"), 4).alias("divergence"))


@query(f"with {EVENTS} select event_id, round(median(value) over (partition by dataset_id order by ts rows between 3 preceding and 3 following), 6) smooth from ev")
def rolling_median_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.events(spark, sf_dir).select("event_id", F.round(resample.rolling_median("value", ["dataset_id"], "ts", 6), 6).alias("smooth"))


@query(f"with {EVENTS} select event_id, round(avg(value) over (partition by dataset_id order by ts rows between 4 preceding and current row), 6) smooth from ev")
def rolling_mean_lowpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.events(spark, sf_dir).select("event_id", F.round(resample.rolling_mean("value", ["dataset_id"], "ts"), 6).alias("smooth"))


@query("with s as (select o_custkey, o_orderkey, row_number() over w job_index, o_totalprice / 500000.0 score from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) select o_custkey, o_orderkey, job_index, round(avg(score) over (partition by o_custkey order by job_index rows between 4 preceding and current row), 4) moving_avg from s where score between 0 and 1")
def score_moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    rows = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("job_index"), (F.col("o_totalprice") / 500000.0).alias("score")).where("score between 0 and 1")
    return rows.select("o_custkey", "o_orderkey", "job_index", F.round(F.avg("score").over(w.orderBy("job_index").rowsBetween(-4, 0)), 4).alias("moving_avg"))


@query(f"with {EVENTS}, r as (select *, row_number() over (partition by dataset_id order by event_id) rn, count(*) over (partition by dataset_id) n from ev) select event_id, dataset_id, value from r where (rn - 1) % greatest(1, ceil(n / 100.0)::bigint) = 0")
def stride_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.stride(S.events(spark, sf_dir), ["dataset_id"], "event_id", 100).select("event_id", "dataset_id", "value")


@query("select doc_id, n_chars, lang from documents order by n_chars desc, doc_id limit 5")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").orderBy(F.desc("n_chars"), "doc_id").limit(5)


@query("select lang, source, n_chars citations from (select lang, source, n_chars, row_number() over (partition by lang, source order by n_chars desc, doc_id) rn from documents) where rn = 1")
def keep_max_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.max("n_chars").alias("citations"))


@query(f"with {IMU} select pos, " + ", ".join(f"round(sqrt({s}_x{d}*{s}_x{d}+{s}_y{d}*{s}_y{d}+{s}_z{d}*{s}_z{d}), 6) {s}_dataset{d}" for s in ("acc", "gyro") for d in (1, 2)) + " from imu where pos < 1000")
def magnitude_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first 1000 rows, as its SQL has it; all rows are those of ``magnitude_overlay_whole``."""
    return magnitude_overlay_whole(spark, sf_dir).where("pos < 1000")


@query(f"with {IMU} select pos, " + ", ".join(f"round(sqrt({s}_x{d}*{s}_x{d}+{s}_y{d}*{s}_y{d}+{s}_z{d}*{s}_z{d}), 6) {s}_dataset{d}" for s in ("acc", "gyro") for d in (1, 2)) + " from imu")
def magnitude_overlay_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda s, d: F.round(C.magnitude(*(F.col(f"{s}_{a}{d}") for a in "xyz")), 6).alias(f"{s}_dataset{d}")
    return S.imu(spark, sf_dir).select("pos", *(m(s, d) for s in ("acc", "gyro") for d in (1, 2)))


@query(f"with {IMU}, a as (select label, avg(sqrt(acc_x1*acc_x1+acc_y1*acc_y1+acc_z1*acc_z1)) m from imu group by 1) select label, round(m, 6) mean_magnitude, case when m between 0.7 and 1.3 then 'g' when m between 8 and 11 then 'ms2' else 'unknown' end unit, round(m * case when m between 0.7 and 1.3 then 9.81 else 1.0 end, 6) scaled from a")
def unit_detect_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = S.imu(spark, sf_dir).groupBy("label").agg(F.avg(C.magnitude(*(F.col(f"acc_{x}1") for x in "xyz"))).alias("m"))
    unit = C.unit_of(F.col("m"))
    return a.select("label", F.round("m", 6).alias("mean_magnitude"), unit.alias("unit"), F.round(F.col("m") * F.when(unit == "g", 9.81).otherwise(1.0), 6).alias("scaled"))


@query(f"with {IMU}, m as (select label, avg(acc_x1) x, avg(acc_y1) y, avg(acc_z1) z from imu group by 1), u as (unpivot m on x, y, z into name axis value v), r as (select *, row_number() over (partition by label order by abs(v) desc, axis) rn from u) select label, axis, round(v, 6) mean_value, v < 0 and abs(v) > 0.05 invert from r where rn = 1")
def axis_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.imu(spark, sf_dir).groupBy("label").agg(*(F.avg(f"acc_{a}1").alias(a) for a in "xyz"))
    # Of equal means the first axis wins: candidates are in order, and max keeps the later only if greater.
    best = F.array_max(F.array(*(F.struct(F.abs(F.col(a)).alias("size"), F.lit(-i).alias("order"), F.lit(a).alias("axis"), F.col(a).alias("v")) for i, a in enumerate("xyz"))))
    return m.select("label", best.alias("b")).select("label", "b.axis", F.round("b.v", 6).alias("mean_value"), ((F.col("b.v") < 0) & (F.abs(F.col("b.v")) > 0.05)).alias("invert"))


@query(f"with {EVENTS}, d as (select dataset_id, value, value - lag(value) over (partition by dataset_id order by ts) diff from ev) select dataset_id, round(stddev_pop(diff) / (stddev_pop(value) + 1e-9), 6) noise_ratio, round(tanh(var_pop(value) / 5), 6) variance_score from d group by 1 having count(*) >= 20")
def noise_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.events(spark, sf_dir).withColumn("diff", F.col("value") - F.lag("value").over(Window.partitionBy("dataset_id").orderBy("ts")))
    return d.groupBy("dataset_id").agg(F.round(F.stddev_pop("diff") / (F.stddev_pop("value") + 1e-9), 6).alias("noise_ratio"), F.round(F.tanh(F.var_pop("value") / 5), 6).alias("variance_score"), F.count(F.lit(1)).alias("n")).where("n >= 20").drop("n")


@query(f"""with {PAIR}, e as (select least(min(x), min(y)) lo, greatest(max(x), max(y)) hi, count(*) n from pair), v as (select 'x' s, x v from pair union all select 'y', y from pair),
 b as (select s, least(floor((v - lo)/(hi - lo)*47), 46)::bigint bin from v cross join e where hi > lo), c as (select bin, count(*) filter (where s = 'x') cx, count(*) filter (where s = 'y') cy from b group by 1),
 d as (select g.bin, coalesce(cx, 0) / n / ((hi - lo)/47) + 1e-9 px, coalesce(cy, 0) / n / ((hi - lo)/47) + 1e-9 py from (select unnest(generate_series(0, 46)) bin) g cross join e left join c on c.bin = g.bin),
 s as (select px / sum(px) over () p, py / sum(py) over () q from d) select round(0.5 * sum((p - q) * ln(p / q)), 6) kl, round(exp(-0.5 * sum((p - q) * ln(p / q))), 6) kl_similarity from s""")
def hist_symmetric_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.histogram_similarity(S.pair(spark, sf_dir), ["grp"]).select("kl", "kl_similarity"), 6, "kl", "kl_similarity")


@query(f"with {PAIR}, a as (select row_number() over (order by x) rk, x from pair), b as (select row_number() over (order by y) rk, y from pair), u as (select x v from pair union all select y from pair) select round((select avg(abs(x - y)) from a join b using (rk)), 6) distance, round(exp(-(select avg(abs(x - y)) from a join b using (rk)) / (3 * ((select stddev_pop(v) from u) + 1e-6))), 6) similarity")
def wasserstein_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.wasserstein(S.pair(spark, sf_dir), ["grp"]).select("distance", "similarity"), 6, "distance", "similarity")


SNR = "select var_pop(s) / (var_pop(v - s) + 1e-9) snr from (select {0} v, sum({0}) over (order by pos rows between {1} preceding and {1} following) / {2} s from pair)"


@query(f"with {PAIR}, n as (select count(*) n from pair), a as ({SNR.format('x', 12, 25)}), b as ({SNR.format('y', 12, 25)}) select round(a.snr, 6) snr_x, round(b.snr, 6) snr_y, round(1 - least(1.0, abs(log10(a.snr + 1) - log10(b.snr + 1)) / 2), 6) consistency from a, b")
def snr_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.pair(spark, sf_dir)
    both = signals.snr(p, ["grp"], "x", 25).withColumnRenamed("snr", "a").join(signals.snr(p, ["grp"], "y", 25).withColumnRenamed("snr", "b"), "grp")
    gap = F.abs(F.log10(F.col("a") + 1) - F.log10(F.col("b") + 1)) / 2
    return both.select(F.round("a", 6).alias("snr_x"), F.round("b", 6).alias("snr_y"), F.round(1 - F.least(F.lit(1.0), gap), 6).alias("consistency"))


@query(f"with {PAIR}, c as (select pos, x - avg(x) over () x, y - avg(y) over () y from pair), s as (select a.pos - b.pos lag, round(sum(a.x * b.y), 9) corr from c a, c b group by 1), t as (select lag, corr, row_number() over (order by corr desc, lag) rn from s) select lag, round(corr / ((select sqrt(sum(x*x)) * sqrt(sum(y*y)) from c) + 1e-9), 6) peak, greatest(-5.0, least(5.0, lag / 20.0)) offset_seconds from t where rn = 1")
def xcorr_offset_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of the greatest correlation over the whole length."""
    return peak_offset(S.pair(spark, sf_dir))


def peak_offset(pairs: DataFrame) -> DataFrame:
    best = signals.cross_correlation(pairs, ["grp"])
    return best.select("lag", F.round("peak", 6).alias("peak"), C.clip(F.col("lag") / 20.0, -5.0, 5.0).alias("offset_seconds"))


@query(f"with {PAIR}, w as (select unnest(generate_series(0, (select max(pos) + 1 - 100 from pair), 50)) start_pos), r as (select w.start_pos, p.* from w join pair p on p.pos >= w.start_pos and p.pos < w.start_pos + 100), m as (select start_pos, round(corr(x, y), 6) correlation, round(avg(x) - avg(y), 6) mean_gap from r group by 1) select * from m")
def windowed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of 100 samples, 50 apart. Each sample names its windows; nothing is joined by range."""
    p = S.pair(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("grp")))
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - 99) / 50)).cast("long")
    last = F.least(F.floor(F.col("pos") / 50), F.floor((F.col("n") - 100) / 50)).cast("long")
    rows = p.where(last >= first).select("x", "y", F.explode(F.transform(F.sequence(first, last), lambda k: k * 50)).alias("start_pos"))
    return rows.groupBy("start_pos").agg(F.round(F.corr("x", "y"), 6).alias("correlation"), F.round(F.avg("x") - F.avg("y"), 6).alias("mean_gap"))


@query(f"with {PAIR}, w as (select pos // 100 idx, round(avg(x) - avg(y), 9) off from pair group by 1), s as (select avg(abs(off)) mean_offset, regr_slope(off, idx) slope from w) select round(mean_offset, 6) mean_offset, round(slope, 6) slope, case when mean_offset < 0.01 and abs(slope) < 0.0005 then 'none' when mean_offset < 0.05 and abs(slope) < 0.002 then 'minor' else 'significant' end drift, round(greatest(0.0, 1 - (0.5 * least(1.0, mean_offset / 0.1) + 0.3 * least(1.0, abs(slope) / 0.005))), 6) stability from s")
def drift_slope_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.pair(spark, sf_dir).groupBy(F.floor(F.col("pos") / 100).alias("idx")).agg(F.round(F.avg("x") - F.avg("y"), 9).alias("off"))
    s = w.agg(F.avg(F.abs("off")).alias("mean_offset"), F.regr_slope("off", "idx").alias("slope"))
    size, tilt = F.col("mean_offset"), F.abs("slope")
    kind = F.when((size < 0.01) & (tilt < 0.0005), "none").when((size < 0.05) & (tilt < 0.002), "minor").otherwise("significant")
    stability = C.clip(1 - (0.5 * F.least(F.lit(1.0), size / 0.1) + 0.3 * F.least(F.lit(1.0), tilt / 0.005)))
    return s.select(F.round(size, 6).alias("mean_offset"), F.round("slope", 6).alias("slope"), kind.alias("drift"), F.round(stability, 6).alias("stability"))


PROFILE_ROWS = ", ".join(f"('{name}', {', '.join(map(str, w))})" for name, w in registry.WEIGHTS.items())


@query(f"with p(profile, a, b, c, d, e, f) as (values {PROFILE_ROWS}), s as (select label, least(1.0, abs(avg(embedding[1]))) v1, least(1.0, abs(avg(embedding[2]))) v2 from embeddings group by 1) select label, profile, round(greatest(0.0, least(1.0, a::double*v1 + b::double*v2 + c::double*0.5 + d::double*(1-v1) + e::double*v2 + f::double*0.7)), 6) hqscore from p cross join s")
def hqscore_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted score of each label's components under every weight profile."""
    s = S.table(spark, sf_dir, "embeddings").groupBy("label").agg(*(F.least(F.lit(1.0), F.abs(F.avg(F.col("embedding")[i].cast("double")))).alias(f"v{i + 1}") for i in (0, 1)))
    parts = [F.col("v1"), F.col("v2"), F.lit(0.5), 1 - F.col("v1"), F.col("v2"), F.lit(0.7)]
    scores = F.explode(F.array(*(F.struct(F.lit(name).alias("profile"), F.round(C.weighted(w, parts), 6).alias("hqscore")) for name, w in registry.WEIGHTS.items())))
    return s.select("label", scores.alias("s")).select("label", "s.*")


@query("select o_orderkey, o_totalprice / 500000.0 score, case when o_totalprice / 500000.0 >= 0.8 then 'High' when o_totalprice / 500000.0 >= 0.55 then 'Medium' else 'Low' end as level from orders")
def confidence_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("o_totalprice") / 500000.0
    return S.table(spark, sf_dir, "orders").select("o_orderkey", score.alias("score"), C.confidence(score).alias("level"))


@query("with t as (select p_partkey, regexp_extract_all(concat('sampled at ', p_size, ' Hz and 900hz or ', p_partkey % 7, ' hz'), '\\b(\\d{1,3})\\s*[hH][zZ]\\b', 1)::bigint[] f from part), v as (select p_partkey, list_sort(list_filter(f, lambda x: x between 5 and 400)) f from t) select p_partkey, len(f) n_rates, f[len(f) // 2 + 1] upper_median from v")
def hz_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("sampled at "), "p_size", F.lit(" Hz and 900hz or "), F.col("p_partkey") % 7, F.lit(" hz"))
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,3})\s*[hH][zZ]\b"), 1), lambda x: x.cast("long"))
    rows = S.table(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.filter(found, lambda x: x.between(5, 400))).alias("f"))
    return rows.select("p_partkey", F.size("f").cast("long").alias("n_rates"), F.get("f", F.expr("cast(size(f) div 2 as int)")).alias("upper_median"))


@query("select event_id, json_valid(props) valid, value from events where value > 0 and value <= 100")
def json_ledger_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose value is in range, with whether their JSON text parses."""
    return S.table(spark, sf_dir, "events").where("value > 0 and value <= 100").select("event_id", F.from_json("props", "map<string,string>").isNotNull().alias("valid"), "value")


@query(f"with {EVENTS}, p as (select participant_id, dataset_id, avg(value) score, count(*) n from ev group by all) select participant_id, round(avg(score), 4) mean_score, sum(n)::bigint n_rows, max_by(dataset_id, struct_pack(a := score, b := dataset_id)) worst, bool_or(score > 90) any_high, count(*) n_datasets from p group by 1")
def participant_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.events(spark, sf_dir).groupBy("participant_id", "dataset_id").agg(F.avg("value").alias("score"), F.count(F.lit(1)).alias("n"))
    return p.groupBy("participant_id").agg(F.round(F.avg("score"), 4).alias("mean_score"), F.sum("n").alias("n_rows"), F.max_by("dataset_id", F.struct("score", "dataset_id")).alias("worst"), F.bool_or(F.col("score") > 90).alias("any_high"), F.count(F.lit(1)).alias("n_datasets"))


@query("select p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') label from part")
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "part").select("p_partkey", C.normal_label(F.col("p_name")).alias("label"))


@query(f"with {EVENTS} select dataset_id, round(0.6 * (1 - avg((value is null)::double)) + 0.4 * least(1.0, var_samp(value) / 100), 6) v3_score from ev group by 1")
def missing_variance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = 0.6 * (1 - F.avg(F.col("value").isNull().cast("double"))) + 0.4 * F.least(F.lit(1.0), F.var_samp("value") / 100)
    return S.events(spark, sf_dir).groupBy("dataset_id").agg(F.round(score, 6).alias("v3_score"))


@query(RATES + """, d as (select event_type dataset_id, (epoch_us(max(ts)) - epoch_us(min(ts)))/1e6 dur from events group by 1), x as (select dataset_id, coalesce(case when g > 0 then 1/g end, 0.0) rate, dur from m join d using (dataset_id)),
 s as (select dataset_id, 0.05 + 0.35 + case when rate between 20 and 120 then 0.25 else 0 end + case when dur <= 14400 then 0.08 else 0 end har, 0.05 + case when rate between 40 and 200 then 0.30 else 0 end gait, 0.05 + case when dur >= 10800 then 0.26 else 0 end + case when dur >= 28800 then 0.15 else 0 end free from x)
 select dataset_id, case when har >= gait and har >= free then 'Human Activity Recognition' when gait >= free then 'Gait Analysis' else 'Free-living Monitoring' end task, round(greatest(har, gait, free)::double, 6) score from s""")
def task_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams taken as acceleration with gyroscope: the best-fitting task by rate and duration."""
    e = S.events(spark, sf_dir)
    x = rates.sampling_rate(e, ["dataset_id"], digits=None, default=0.0).join(e.groupBy("dataset_id").agg((C.seconds(F.max("ts")) - C.seconds(F.min("ts"))).alias("dur")), "dataset_id")
    points = lambda condition, value: F.when(condition, value).otherwise(0.0)
    rate, dur = F.col("rate_hz"), F.col("dur")
    tasks = [("Human Activity Recognition", F.lit(0.05) + 0.35 + points(rate.between(20, 120), 0.25) + points(dur <= 14400, 0.08)), ("Gait Analysis", F.lit(0.05) + points(rate.between(40, 200), 0.30)), ("Free-living Monitoring", F.lit(0.05) + points(dur >= 10800, 0.26) + points(dur >= 28800, 0.15))]
    best = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("task")) for i, (t, s) in enumerate(tasks))))
    return x.select("dataset_id", best.alias("b")).select("dataset_id", "b.task", F.round("b.score", 6).alias("score"))


@query(f"with {EVENTS}, c as (select dataset_id, value from ev where value is not null), s as (select dataset_id, case when avg(value) between 8.5 and 11.5 then 1.0 when avg(value) between 0.8 and 1.2 then 0.7 else 0.3 end::double physics, avg(value) m from c group by 1) select dataset_id, physics, round(m, 6) mean_value from s")
def physics_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.avg("value")
    score = F.when(m.between(8.5, 11.5), 1.0).when(m.between(0.8, 1.2), 0.7).otherwise(0.3)
    return S.events(spark, sf_dir).where("value is not null").groupBy("dataset_id").agg(score.alias("physics"), F.round(m, 6).alias("mean_value"))


@query("select c_custkey, c_mktsegment, c_acctbal from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def semi_join_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = S.table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return S.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").join(big, "c_custkey", "left_semi")


@query("select lang, source, max(n_chars) n_chars from documents group by all order by n_chars desc, lang, source limit 5")
def research_top_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.top_papers(S.table(spark, sf_dir, "documents"), ["lang", "source"], "n_chars")


@query("with g as (select o_orderkey, o_totalprice / 500000.0 - 0.3 gain from orders) select o_orderkey, round(gain, 6) gain, (case when gain <= 0 then 0.3 when gain < 0.01 then 0.6 when gain < 0.05 then 0.8 else 0.95 end)::double confidence, case when gain >= 0 then 'accepted' else 'rejected' end verdict from g")
def observer_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    gain = F.col("o_totalprice") / 500000.0 - 0.3
    return S.table(spark, sf_dir, "orders").select("o_orderkey", C.rounded(gain, 6).alias("gain"), decisions.observer_confidence(gain).alias("confidence"), decisions.accepted_change(F.lit(0.0), gain).alias("verdict"))


@query(f"with {EVENTS}, w as (select dataset_id, ts, case when event_id % 5 <> 0 then value end v from ev), m as (select dataset_id, v, median(v) over (partition by dataset_id order by ts rows between 2 preceding and 2 following) s from w) select dataset_id, sum((v is null)::bigint)::bigint n_missing, sum((coalesce(v, s) is null)::bigint)::bigint n_left, round(avg(coalesce(v, s)), 6) mean_value from m group by 1")
def fill_by_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.events(spark, sf_dir).select("dataset_id", "ts", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    m = w.withColumn("filled", F.coalesce("v", resample.rolling_median("v", ["dataset_id"], "ts", 5)))
    return m.groupBy("dataset_id").agg(F.sum(F.col("v").isNull().cast("long")).alias("n_missing"), F.sum(F.col("filled").isNull().cast("long")).alias("n_left"), F.round(F.avg("filled"), 6).alias("mean_value"))


@query()
def signal_pair_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant frequency, coherence and warping cost; held against direct formulas in the tests."""
    return rounded(signals.pair_kernels(S.pair(spark, sf_dir), "grp", 20.0), 6, "freq_x", "freq_y", "coherence", "dtw")
