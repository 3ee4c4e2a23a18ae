"""Run telemetry: meters, timings, early stopping and loss traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clipalign.operators.ordering import exact_quantiles, row_numbers, running_totals


def weighted_meter(df: DataFrame, groups: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean and the total weight."""
    return df.groupBy(*groups).agg(
        F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))


def gather_workers(df: DataFrame, groups: Sequence[str], worker: str, value: str) -> DataFrame:
    """Unweighted mean of the worker means; the rows of all workers stay together as one table."""
    means = df.groupBy(*groups, worker).agg(F.avg(value).alias("_m"), F.count(value).alias("_n"))
    return means.groupBy(*groups).agg(
        F.avg("_m").alias("mean"), F.count(F.lit(1)).alias("workers"), F.sum("_n").alias("items"))


def timing_summary(samples: DataFrame, stage: str = "stage", seconds: str = "seconds") -> DataFrame:
    """Count, mean, median, nearest-index p90, extremes, total and share of the overall total per stage."""
    total = F.sum(F.col(seconds) * F.col("n"))
    summary = exact_quantiles(
        samples, seconds, {"median_s": 0.5, "p90_s": 0.9}, [stage], nearest=["p90_s"],
        figures={"n": F.sum("n"), "mean_s": total / F.sum("n"), "min_s": F.min(seconds), "max_s": F.max(seconds), "total_s": total})
    stages = Window.partitionBy()  # one row per stage
    return summary.withColumn("share", F.try_divide(F.col("total_s"), F.sum("total_s").over(stages)))


def per_clip_timing(batches: DataFrame, stages: Sequence[str], warmup: int) -> DataFrame:
    """Batch rows with their phase and each stage divided by the batch size."""
    phase = F.when(F.col("batch_idx") < warmup, "warmup").otherwise("timed")
    per_clip = [F.try_divide(F.col(f"{s}_s"), F.col("batch_size")).alias(f"{s}_per_clip_s") for s in stages]
    return batches.select("*", phase.alias("phase"), *per_clip)


def steady_timing(batches: DataFrame, run: str, order: str, seconds: str, skip: int = 5) -> DataFrame:
    """Mean of all batches and without the first ``skip``, with extremes."""
    numbered = row_numbers(batches, [F.col(order)], [run], rank="_row")
    return numbered.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), F.avg(seconds).alias("avg_s"),
        F.avg(F.when(F.col("_row") > skip, F.col(seconds))).alias("steady_avg_s"),
        F.min(seconds).alias("min_s"), F.max(seconds).alias("max_s"))


def rolling_batch_time(
    batches: DataFrame, run: str, order: str, seconds: str, width: int = 25, skip: int = 5
) -> DataFrame:
    """Reports at every ``width``-th batch: mean of the last ``width``, of all, and of all but the first ``skip``.

    Batch 0 reports alone; later reports cover whole blocks, so block sums and their running totals suffice.
    """
    numbered = row_numbers(batches, [F.col(order)], [run], rank="_row").withColumn("batch", F.col("_row") - 1)
    steady = F.col("batch") >= skip
    blocks = numbered.groupBy(run, F.ceil(F.col("batch") / width).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("sum_s"),
        F.count_if(steady).alias("n_steady"), F.coalesce(F.sum(F.when(steady, F.col(seconds))), F.lit(0.0)).alias("sum_steady"),
        F.max_by(seconds, "batch").alias("last_s"),
    )
    totals = running_totals(
        blocks, [F.col("block")],
        {"n_all": F.col("n"), "s_all": F.col("sum_s"), "n_st": F.col("n_steady"), "s_st": F.col("sum_steady")}, [run])
    # all blocks before a report are full; block 0 holds batch 0 only
    recent = (F.col("block") == 0) | (F.col("n") == width)
    return totals.where(recent).select(
        run, (F.col("block") * width).alias("batch"), "last_s",
        (F.col("sum_s") / F.col("n")).alias("recent_avg_s"),
        (F.col("s_all") / F.col("n_all")).alias("global_avg_s"),
        F.try_divide("s_st", "n_st").alias("steady_avg_s"),
    )


def loss_range(points: DataFrame, groups: Sequence[str], order: str, value: str) -> DataFrame:
    """Smallest, largest and last known value per group."""
    known = points.where(F.col(value).isNotNull())
    return known.groupBy(*groups).agg(
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.max_by(value, order).alias("last_value"))


def epoch_last_point(points: DataFrame, phase: str, epoch: str, order: Sequence[str]) -> DataFrame:
    """The last logged row per phase and epoch; combined on the map side, nothing is sorted."""
    rest = [c for c in points.columns if c not in (phase, epoch)]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return points.groupBy(phase, epoch).agg(last).select(phase, epoch, "_last.*")


def trace_axis(points: DataFrame, phase: str = "Train") -> DataFrame:
    """Samples seen since the start of training: epoch x largest phase total + seen in the phase."""
    chosen = points.where(F.col("phase") == phase)
    total = chosen.agg(F.max("phase_total")).scalar()
    return chosen.withColumn("global_seen", F.col("epoch") * total + F.col("seen_in_phase"))


def early_stopping(history: DataFrame, patience: int, to_max: bool) -> DataFrame:
    """Best value so far, epochs without change and the stop mark after each epoch of a run.

    The history has one row per run and epoch, so a run's window is as short as its training.
    """
    runs = Window.partitionBy("run").orderBy("epoch")
    before = runs.rowsBetween(Window.unboundedPreceding, -1)
    upto = runs.rowsBetween(Window.unboundedPreceding, 0)
    start = F.lit(0.0 if to_max else float("inf"))
    extreme, pick = (F.max, F.greatest) if to_max else (F.min, F.least)
    best_before = F.coalesce(pick(start, extreme("metric").over(before)), start)
    improved = F.col("metric") > best_before if to_max else F.col("metric") < best_before
    marked = history.withColumn("improved", improved).withColumn("_row", F.row_number().over(runs))
    last_change = F.coalesce(F.max(F.when(F.col("improved"), F.col("_row"))).over(upto), F.lit(0))
    counted = marked.withColumn("no_change", (F.col("_row") - last_change).cast("bigint")).withColumn(
        "best", pick(start, extreme("metric").over(upto)))
    stopped = F.max((F.col("no_change") >= patience).cast("int")).over(upto) == 1
    return counted.withColumn("triggered", stopped).drop("_row")


def progress_lines(batches: DataFrame) -> DataFrame:
    """Percent done and throughput, over all devices and per device, with the formatted line."""
    percent = F.lit(100.0) * (F.col("batch_idx") + 1) / F.col("num_batches")
    per_device = F.try_divide(F.col("batch_size").cast("double"), F.col("batch_seconds"))
    total = per_device * F.col("world_size")
    shown = batches.withColumn("percent", percent).withColumn("samples_per_s", total).withColumn(
        "samples_per_s_per_device", per_device)
    line = F.concat(
        F.col("phase"), F.lit(" ("), F.col("epoch").cast("string"), F.lit(") ["),
        ((F.col("batch_idx") + 1) * F.col("batch_size") * F.col("world_size")).cast("string"), F.lit("/"),
        (F.col("num_batches") * F.col("batch_size") * F.col("world_size")).cast("string"), F.lit(" ("),
        F.bround("percent", 0).cast("bigint").cast("string"), F.lit("%)]"))
    return shown.withColumn("line", line)


def stage_ratio(summary: DataFrame, first: str, second: str, stage: str = "stage") -> DataFrame:
    """Total time of one stage over the total time of another, from a timing summary."""
    totals = [F.sum(F.when(F.col(stage) == name, F.col("total_s"))) for name in (first, second)]
    return summary.agg(F.try_divide(*totals).alias("ratio"))


def metric_lookup(metrics: Column, name: str) -> Column:
    """Value of a metric in a text map: its own key, else the first key that ends with the name and holds a number."""
    similar = F.filter(F.map_entries(metrics), lambda e: F.endswith(e["key"], F.lit(name)) & e["value"].try_cast("double").isNotNull())
    fallback = F.get(similar, F.lit(0))["value"].try_cast("double")
    return F.when(F.map_contains_key(metrics, F.lit(name)), F.element_at(metrics, name).try_cast("double")).otherwise(fallback)


def best_epochs(history: DataFrame, maximize: bool) -> DataFrame:
    """Mark every epoch that beats all earlier ones; the first counts as best even without a value.

    The history has one row per run and epoch, as in ``early_stopping``.
    """
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (F.max if maximize else F.min)("metric").over(before)
    beats = F.col("metric") > earlier if maximize else F.col("metric") < earlier
    known = F.when(earlier.isNull(), F.lit(True)).otherwise(beats)
    first = F.count(F.lit(1)).over(before) == 0
    return history.withColumn("is_best", F.when(F.col("metric").isNull(), first).otherwise(known))
