"""Average precision, ROC-AUC, ROC curve and d-prime from running counts over distinct scores."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from clipalign.functions import vectors
from clipalign.operators.ordering import neighbours, running_totals


def one_vs_rest(trials: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One row per trial and class: class, softmax score and whether it is the target."""
    exploded = trials.select(*groups, "target", F.posexplode(vectors.softmax(F.col("logits"))).alias("cls", "score"))
    return exploded.select(
        *groups, F.col("cls").cast("bigint").alias("cls"), "score", (F.col("cls") == F.col("target")).alias("positive"))


def score_counts(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score, with running counts from the highest score down."""
    distinct = scored.groupBy(*groups, "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    return running_totals(distinct, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, groups)


def area_metrics(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Average precision and ROC-AUC per group; null where a group has only one outcome."""
    runs = score_counts(scored, groups)
    sums = runs.groupBy(*groups).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("_auc"),
    )
    return sums.select(
        *groups, "n_pos", "n_neg",
        F.try_divide("_ap", "n_pos").alias("average_precision"),
        F.try_divide(F.col("_auc"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("roc_auc"),
    )


@F.pandas_udf(DoubleType())
def _normal_quantile(p: pd.Series) -> pd.Series:
    normal = NormalDist()
    return p.map(lambda x: normal.inv_cdf(x) if 0.0 < x < 1.0 else float("nan"))


def ranking_report(trials: DataFrame, n_classes: int, groups: Sequence[str] = ("model_name",)) -> DataFrame:
    """Mean AP, mean AUC and d-prime; fixed stand-in values where a class never occurs as target."""
    per_class = area_metrics(one_vs_rest(trials, groups), [*groups, "cls"])
    report = per_class.groupBy(*groups).agg(
        (F.count_if(F.col("n_pos") > 0) == n_classes).alias("complete"),
        F.avg("average_precision").alias("map"), F.avg("roc_auc").alias("mauc"))
    return report.select(
        *groups,
        F.when(F.col("complete"), F.col("map")).otherwise(F.lit(0.0)).alias("map"),
        F.when(F.col("complete"), F.col("mauc")).otherwise(F.lit(0.5)).alias("mroc_auc"),
    )


def with_dprime(report: DataFrame, auc: str = "mroc_auc") -> DataFrame:
    """Add d-prime; one value per report row goes through Python."""
    return report.withColumn("dprime", _normal_quantile(F.col(auc)) * F.sqrt(F.lit(2.0)))


def roc_curve(scores: DataFrame) -> DataFrame:
    """False and true positive rates per threshold, without points on a straight stretch."""
    labelled = scores.select(F.lit(0).alias("g"), F.col("prob").alias("score"), (F.col("target") == 1).alias("positive"))
    runs = score_counts(labelled, ["g"])
    ends = runs.groupBy("g").agg(F.max("tp").alias("n_pos"), F.max("fp").alias("n_neg"))
    around = neighbours(runs.select("g", "score", "tp", "fp"), [F.col("score").desc()], {"tp": "tp", "fp": "fp"}, ["g"])

    def bend(c: str):
        return (F.col(f"next_{c}") - 2 * F.col(c) + F.col(f"prev_{c}")) != 0

    edge = F.col("prev_tp").isNull() | F.col("next_tp").isNull()
    kept = around.where(edge | bend("tp") | bend("fp")).join(F.broadcast(ends), "g").select(  # ends is one row
        F.try_divide("fp", "n_neg").alias("fpr"), F.try_divide("tp", "n_pos").alias("tpr"),
        F.col("score").alias("threshold"))
    start = ends.select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return start.unionByName(kept)
