"""Streaming queries: the stream's final table must equal the batch result on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign import views
from clipalign.catalog import query, tidy
from clipalign.catalog.ctes import HISTORY, r6, with_ctes
from clipalign.catalog.evaluation import ROWS, _rows
from clipalign.catalog.telemetry import METER, POINTS, _meter, _points, _stop_sql
from clipalign.session import scratch_path
from clipalign.streaming import telemetry as st


def _arriving(df: DataFrame, name: str) -> DataFrame:
    """Write a table as its partitions' files and follow them as a stream, in each batch as many files as tasks run at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return st.follow_files(spark, path, df.schema, files_per_batch=spark.sparkContext.defaultParallelism)


@query("stream_running_accuracy", with_ctes([ROWS], f"""
SELECT model_name, count(*) AS num_trials, {r6("avg((pred = target)::INT)", "accuracy_1")},
  {r6("avg((abs(pred - target) <= 1)::INT)", "accuracy_1_pm1_class")} FROM good GROUP BY 1"""))
def stream_running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("model_name", "status", "top1_correct", "top1_pm1_class_correct")
    return tidy(st.drain(st.running_accuracy(_arriving(rows, "trials")), "complete", "running-accuracy"))


@query("stream_meter", with_ctes([METER], f"""
SELECT phase, metric, {r6("sum(value * n) / sum(n)", "mean")}, sum(n)::BIGINT AS weight FROM meter GROUP BY 1, 2"""))
def stream_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _arriving(_meter(spark, sf_dir), "meter")
    return tidy(st.drain(st.running_meter(values), "complete", "running-meter"))


@query("stream_epoch_last", with_ctes([POINTS], f"""
SELECT phase, epoch, seen_in_phase, phase_total, {r6("loss", "loss")} FROM points
QUALIFY row_number() OVER (PARTITION BY phase, epoch ORDER BY seen_in_phase DESC) = 1"""))
def stream_epoch_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(st.drain(st.running_last_point(_arriving(_points(spark, sf_dir), "points")), "complete", "last-point"))


@query("stream_early_stop", with_ctes([HISTORY], _stop_sql(">", "max", "0.0::DOUBLE", "greatest")))
def stream_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs arrive shuffled: those of odd number first, and the files of a set hold them in no order."""
    history = views.metric_history(spark, sf_dir)
    path = scratch_path(spark, "history")
    mixed = history.withColumn("_digest", F.md5(F.concat_ws(":", "run", F.col("epoch").cast("string")))).repartitionByRange(8, "_digest").drop("_digest")
    mixed.where("epoch % 2 = 1").write.parquet(path)
    earlier = len(spark.read.parquet(path).inputFiles())
    mixed.where("epoch % 2 = 0").write.mode("append").parquet(path)
    stream = st.follow_files(spark, path, history.schema, files_per_batch=-(-earlier // 2))
    return tidy(st.drain(st.running_early_stop(stream, 3, True), "append", "early-stop"))
