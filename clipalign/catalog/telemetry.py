"""Run telemetry queries: meters, timings, early stopping and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign import views
from clipalign.catalog import query, tidy
from clipalign.catalog.ctes import HISTORY, r6, with_ctes
from clipalign.operators import telemetry as tm

STAGES = ["data_wait", "prepare_h2d", "model_forward", "end_to_end"]


def _meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 3 == 0, "valid").otherwise("train").alias("phase"),
        F.col("event_type").alias("metric"), F.col("value"), (F.col("event_id") % 7 + 1).alias("n"),
        (F.col("user_id") % 4).alias("worker"))


METER = """
meter AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'valid' ELSE 'train' END AS phase, event_type AS metric, value,
                 event_id % 7 + 1 AS n, user_id % 4 AS worker FROM events)"""


@query("weighted_mean_meter", with_ctes([METER], f"""
SELECT phase, metric, {r6("sum(value * n) / sum(n)", "mean")}, sum(n)::BIGINT AS weight FROM meter GROUP BY 1, 2"""))
def weighted_mean_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(tm.weighted_meter(_meter(spark, sf_dir), ["phase", "metric"], "value", "n"))


@query("worker_gather", with_ctes([METER, """
w AS (SELECT phase, metric, worker, avg(value) AS m, count(*) AS n FROM meter GROUP BY 1, 2, 3)"""], f"""
SELECT phase, metric, {r6("avg(m)", "mean")}, count(*) AS workers, sum(n)::BIGINT AS items FROM w GROUP BY 1, 2"""))
def worker_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(tm.gather_workers(_meter(spark, sf_dir), ["phase", "metric"], "worker", "value"))


@query("timing_summary", with_ctes(["""
s AS (SELECT event_type AS stage, value AS seconds FROM events)"""], f"""
SELECT stage, count(*) AS n, {r6("avg(seconds)", "mean_s")}, {r6("min(seconds)", "min_s")}, {r6("max(seconds)", "max_s")},
  {r6("sum(seconds)", "total_s", 4)}, {r6("median(seconds)", "median_s")},
  {r6("list_sort(list(seconds))[round_even((count(*) - 1) * 0.9::DOUBLE, 0)::BIGINT + 1]", "p90_s")},
  {r6("sum(seconds) / (SELECT sum(seconds) FROM s)", "share")} FROM s GROUP BY 1"""))
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = tm.timing_summary(views.stage_times(spark, sf_dir))
    return tidy(summary.withColumn("total_s", F.round("total_s", 4)))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("run"), F.col("event_id").alias("batch_idx"),
        (F.col("event_id") % 9).alias("batch_size"), (F.col("value") / 4).alias("data_wait_s"),
        (F.col("value") / 8).alias("prepare_h2d_s"), F.col("value").alias("model_forward_s"),
        (F.col("value") * 1.375).alias("end_to_end_s"))


_PARTS = {"data_wait": "value / 4", "prepare_h2d": "value / 8", "model_forward": "value", "end_to_end": "value * 1.375::DOUBLE"}


@query("per_clip_timing", "SELECT event_type AS run, event_id AS batch_idx, event_id % 9 AS batch_size, "
       "CASE WHEN event_id < 100 THEN 'warmup' ELSE 'timed' END AS phase, "
       + ", ".join(r6(e, f"{n}_s", 9) for n, e in _PARTS.items()) + ", "
       + ", ".join(r6(f"{e} / nullif(event_id % 9, 0)", f"{n}_per_clip_s", 9) for n, e in _PARTS.items()) + " FROM events")
def per_clip_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(tm.per_clip_timing(_batches(spark, sf_dir), STAGES, 100), 9)


@query("steady_timing", with_ctes(["""
n AS (SELECT event_type AS run, value AS s, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events)"""], f"""
SELECT run, count(*) AS n, {r6("avg(s)", "avg_s")}, {r6("avg(s) FILTER (r > 5)", "steady_avg_s")}, {r6("min(s)", "min_s")},
  {r6("max(s)", "max_s")} FROM n GROUP BY 1"""))
def steady_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(tm.steady_timing(_batches(spark, sf_dir), "run", "batch_idx", "model_forward_s"))


@query("rolling_batch_time", with_ctes(["""
n AS (SELECT event_type AS run, value AS s, event_id,
             row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS batch FROM events)""", """
w AS (SELECT run, batch, s AS last_s, avg(s) OVER (p ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS recent,
             avg(s) OVER (p ROWS UNBOUNDED PRECEDING) AS everything,
             avg(s) FILTER (batch >= 5) OVER (p ROWS UNBOUNDED PRECEDING) AS steady
      FROM n WINDOW p AS (PARTITION BY run ORDER BY event_id))"""], f"""
SELECT run, batch, {r6("last_s", "last_s")}, {r6("recent", "recent_avg_s")}, {r6("everything", "global_avg_s")},
  {r6("steady", "steady_avg_s")} FROM w WHERE batch % 25 = 0"""))
def rolling_batch_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(tm.rolling_batch_time(_batches(spark, sf_dir), "run", "batch_idx", "model_forward_s"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 4 == 0, "Eval").otherwise("Train").alias("phase"),
        (F.dayofyear("ts") - 1).cast("bigint").alias("epoch"),
        F.col("event_id").alias("seen_in_phase"),
        (F.lit(1000) + F.col("event_id") % 10).alias("phase_total"),
        F.when(F.col("event_id") % 6 != 1, F.col("value")).alias("loss"))


POINTS = """
points AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'Eval' ELSE 'Train' END AS phase, (dayofyear(ts) - 1)::BIGINT AS epoch,
                  event_id AS seen_in_phase, 1000 + event_id % 10 AS phase_total,
                  CASE WHEN event_id % 6 <> 1 THEN value END AS loss FROM events)"""


@query("epoch_last_point", with_ctes([POINTS], f"""
SELECT phase, epoch, seen_in_phase, phase_total, {r6("loss", "loss")} FROM points
QUALIFY row_number() OVER (PARTITION BY phase, epoch ORDER BY seen_in_phase DESC) = 1"""))
def epoch_last_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(tm.epoch_last_point(_points(spark, sf_dir), "phase", "epoch", ["seen_in_phase"]))


@query("loss_range", with_ctes([POINTS], f"""
SELECT phase, {r6("min(loss)", "min_value")}, {r6("max(loss)", "max_value")},
  {r6("arg_max(loss, seen_in_phase)", "last_value")} FROM points WHERE loss IS NOT NULL GROUP BY 1"""))
def loss_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(tm.loss_range(_points(spark, sf_dir), ["phase"], "seen_in_phase", "loss"))


@query("train_trace_axis", with_ctes([POINTS], f"""
SELECT phase, epoch, seen_in_phase, phase_total, {r6("loss", "loss")},
  epoch * (SELECT max(phase_total) FROM points WHERE phase = 'Train' AND loss IS NOT NULL) + seen_in_phase AS global_seen
FROM points WHERE phase = 'Train' AND loss IS NOT NULL"""))
def train_trace_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(tm.trace_axis(_points(spark, sf_dir).where("loss is not null")))


def _stop_sql(better: str, extreme: str, start: str, pick: str) -> str:
    return f"""
SELECT run, epoch, {r6("metric", "metric")}, improved, no_change, {r6("best", "best")},
  max((no_change >= 3)::INT) OVER (PARTITION BY run ORDER BY epoch) = 1 AS triggered
FROM (
  SELECT run, epoch, metric, improved, (r - coalesce(max(CASE WHEN improved THEN r END) OVER w, 0))::BIGINT AS no_change,
         {pick}({start}, {extreme}(metric) OVER w) AS best
  FROM (SELECT *, metric {better} {pick}({start}, coalesce({extreme}(metric) OVER (PARTITION BY run ORDER BY epoch
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {start})) AS improved,
          row_number() OVER (PARTITION BY run ORDER BY epoch) AS r FROM history)
  WINDOW w AS (PARTITION BY run ORDER BY epoch))"""


@query("early_stopping", with_ctes([HISTORY], "SELECT 'max' AS mode, * FROM ("
       + _stop_sql(">", "max", "0.0::DOUBLE", "greatest") + ") UNION ALL SELECT 'min' AS mode, * FROM ("
       + _stop_sql("<", "min", "'inf'::DOUBLE", "least") + ")"))
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = views.metric_history(spark, sf_dir)
    up = tm.early_stopping(history, 3, True).withColumn("mode", F.lit("max"))
    down = tm.early_stopping(history, 3, False).withColumn("mode", F.lit("min"))
    return tidy(up.unionByName(down))


@query("progress_line", with_ctes(["""
b AS (SELECT event_id, event_type AS phase, dayofyear(ts) - 1 AS epoch, event_id % 500 AS batch_idx, 500 AS num_batches,
             event_id % 9 + 1 AS batch_size, 4 AS world_size, value AS batch_seconds FROM events)"""], f"""
SELECT event_id, {r6("100.0::DOUBLE * (batch_idx + 1) / num_batches", "percent")},
  {r6("batch_size / batch_seconds * 4", "samples_per_s")}, {r6("batch_size / batch_seconds", "samples_per_s_per_device")},
  phase || ' (' || epoch || ') [' || ((batch_idx + 1) * batch_size * 4) || '/' || (500 * batch_size * 4) || ' ('
    || round_even(100.0::DOUBLE * (batch_idx + 1) / num_batches, 0)::BIGINT || '%)]' AS line FROM b"""))
def progress_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("phase"), (F.dayofyear("ts") - 1).alias("epoch"),
        (F.col("event_id") % 500).alias("batch_idx"), F.lit(500).alias("num_batches"),
        (F.col("event_id") % 9 + 1).alias("batch_size"), F.lit(4).alias("world_size"),
        F.col("value").alias("batch_seconds"))
    return tidy(tm.progress_lines(e).select(
        "event_id", "percent", "samples_per_s", "samples_per_s_per_device", "line"))


@query("best_epoch", with_ctes([HISTORY, """
h AS (SELECT run, epoch, CASE WHEN epoch % 6 <> 0 THEN metric END AS metric FROM history)""", """
b AS (SELECT *, max(metric) OVER w AS hi, min(metric) OVER w AS lo, count(*) OVER w AS n FROM h
      WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""], " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, run, epoch, {r6('metric', 'metric')}, CASE WHEN metric IS NULL THEN n = 0 WHEN {ref} IS NULL THEN true "
    f"ELSE metric {sign} {ref} END AS is_best FROM b" for mode, ref, sign in (("max", "hi", ">"), ("min", "lo", "<")))))
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics arrive as a text map under a prefixed key, and every sixth epoch has no usable value."""
    text = F.when(F.col("epoch") % 6 != 0, F.col("metric").cast("string")).otherwise(F.lit("n/a"))
    logged = views.metric_history(spark, sf_dir).select(
        "run", "epoch", F.create_map(F.lit("valid/loss"), F.lit("0.5"), F.lit("valid/precision"), text).alias("metrics"))
    history = logged.select("run", "epoch", tm.metric_lookup(F.col("metrics"), "precision").alias("metric"))
    up = tm.best_epochs(history, True).withColumn("mode", F.lit("max"))
    return tidy(up.unionByName(tm.best_epochs(history, False).withColumn("mode", F.lit("min"))))


@query("stage_ratio", f"""
SELECT {r6("sum(value) FILTER (event_type = 'click') / sum(value) FILTER (event_type = 'view')", "ratio")} FROM events""")
def stage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = views.stage_times(spark, sf_dir).groupBy("stage").agg(F.sum("seconds").alias("total_s"))
    return tidy(tm.stage_ratio(totals, "click", "view"))
