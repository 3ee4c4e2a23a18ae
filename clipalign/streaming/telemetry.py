"""Incremental forms of the running reports: accuracy, meters, last points and early stopping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clipalign.session import scratch_path


def follow_files(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """Stream of Parquet files as they arrive in a folder."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", pattern).parquet(path))


def running_accuracy(trials: DataFrame) -> DataFrame:
    """Accuracy so far per model over the rows that worked."""
    return trials.where("status = 'ok'").groupBy("model_name").agg(
        F.count(F.lit(1)).alias("num_trials"), F.avg("top1_correct").alias("accuracy_1"),
        F.avg("top1_pm1_class_correct").alias("accuracy_1_pm1_class"))


def running_meter(values: DataFrame) -> DataFrame:
    """Weighted running mean per phase and metric."""
    return values.groupBy("phase", "metric").agg(
        F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")).alias("mean"), F.sum("n").alias("weight"))


def running_last_point(points: DataFrame) -> DataFrame:
    """Latest logged row per phase and epoch."""
    last = F.max_by(F.struct("seen_in_phase", "phase_total", "loss"), "seen_in_phase").alias("_last")
    return points.groupBy("phase", "epoch").agg(last).select("phase", "epoch", "_last.*")


class EarlyStop(StatefulProcessor):
    """What ``running_early_stop`` keeps of a run: where it stands, and the epochs that came before those they follow."""

    def __init__(self, patience: int, to_max: bool, first: int):
        self.patience, self.to_max, self.first = patience, to_max, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "epoch bigint, best double, stale bigint, triggered boolean")
        self.early = handle.getMapState("early", "epoch bigint", "metric double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = 0.0 if self.to_max else float("inf")
        epoch, best, stale, triggered = self.last.get() if self.last.exists() else (self.first - 1, start, 0, False)
        for frame in rows:
            done = []
            waiting = self.early.exists()
            for at, metric in frame[["epoch", "metric"]].sort_values(["epoch", "metric"]).itertuples(index=False):
                if at > epoch + 1 and not self.early.containsKey((at,)):
                    self.early.updateValue((at,), (metric,))
                    waiting = True
                follows = at == epoch + 1
                while follows:
                    epoch += 1
                    improved = bool(metric > best if self.to_max else metric < best)
                    best, stale = (float(metric), 0) if improved else (best, stale + 1)
                    triggered = triggered or stale >= self.patience
                    done.append((key[0], epoch, metric, improved, best, stale, triggered))
                    follows = waiting and self.early.containsKey((epoch + 1,))
                    if follows:
                        metric = self.early.getValue((epoch + 1,))[0]
                        self.early.removeKey((epoch + 1,))
            yield pd.DataFrame(done, columns=["run", "epoch", "metric", "improved", "best", "no_change", "triggered"])
        self.last.update((epoch, best, stale, triggered))

    def close(self) -> None:
        pass


def running_early_stop(history: DataFrame, patience: int, to_max: bool, first: int = 0) -> DataFrame:
    """Best value, epochs without change and the stop mark after every epoch, kept per run across batches.

    The epochs of a run are numbered from ``first`` without gaps and may come in any order: one that comes too early waits in the state
    until those before it are there, so the rows don't depend on how epochs are dealt to files. Of a repeated epoch the first one counts,
    the smallest metric within a batch. A batch is taken in frames as Spark hands them over, and the rest of the state is four numbers.
    """
    history.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return history.groupBy("run").transformWithStateInPandas(
        EarlyStop(patience, to_max, first),
        "run string, epoch bigint, metric double, improved boolean, best double, no_change bigint, triggered boolean",
        "Append", "None")


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there and return the table it wrote.

    ``complete`` replaces the table in every batch, ``append`` writes each batch to its own folder, so a
    repeated batch overwrites itself.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{out}/current" if mode == "complete" else f"{out}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, f"{name}-state"))
        .foreachBatch(write).trigger(availableNow=True).start())
    query.awaitTermination()
    table = spark.read.schema(stream.schema).parquet(f"{out}/current" if mode == "complete" else out)
    return table.select(*stream.columns)
