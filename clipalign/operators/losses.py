"""Contrastive and classification losses as aggregates over similarity cells and logit arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clipalign.functions import vectors
from clipalign.operators.similarity import batch_cells, mean_vector


def _both_directions(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    return cells.select("batch", F.inline(F.array(
        F.struct(F.lit("v2a").alias("side"), F.col("row").alias("query"), F.col("col").alias("item"), *columns),
        F.struct(F.lit("a2v").alias("side"), F.col("col").alias("query"), F.col("row").alias("item"), *columns),
    )))


def _log_mass(logit: Column, bound: float) -> Column:
    """Aggregate log-sum-exp; logits of unit vectors never exceed ``bound``."""
    return F.ln(F.sum(F.exp(logit - bound))) + bound


def contrastive_loss(pairs: DataFrame, batch_size: int, factor: float) -> DataFrame:
    """Symmetric cross-entropy with the diagonal as target; logits are cosine times ``factor``."""
    cells = _both_directions(batch_cells(pairs, batch_size), ["sim_feat"])
    logit = F.col("sim_feat") * factor
    rows = cells.groupBy("batch", "side", "query").agg(
        (_log_mass(logit, factor) - F.max(F.when(F.col("query") == F.col("item"), logit))).alias("ce")
    )
    # every query counts once per side, so the mean over both sides is the mean of the two means
    return rows.groupBy("batch").agg(F.avg("ce").alias("loss"))


def soft_target_loss(
    pairs: DataFrame, batch_size: int, factor: float, alpha: float, teacher: str = "teacher"
) -> DataFrame:
    """Cross-entropy against ``alpha`` x teacher softmax + (1 - alpha) x diagonal."""
    cells = _both_directions(batch_cells(pairs, batch_size, ["feat", teacher]), ["sim_feat", f"sim_{teacher}"])
    logit, guide = F.col("sim_feat") * factor, F.col(f"sim_{teacher}") * factor
    weight = F.exp(guide - factor)
    rows = cells.groupBy("batch", "side", "query").agg(
        _log_mass(logit, factor).alias("mass"),
        (F.sum(weight * logit) / F.sum(weight)).alias("guided"),
        F.max(F.when(F.col("query") == F.col("item"), logit)).alias("own"),
    )
    expected = F.col("guided") * alpha + F.col("own") * (1 - alpha)
    return rows.groupBy("batch").agg(F.avg(F.col("mass") - expected).alias("loss"))


def distillation_loss(pairs: DataFrame, batch_size: int, factor: float, teacher: str = "teacher") -> DataFrame:
    """Cross-entropy of the student against the teacher softmax, mean of both directions."""
    return soft_target_loss(pairs, batch_size, factor, 1.0, teacher)


def multilevel_loss(
    segments: DataFrame, clips_per_batch: int, n_segments: int, factor: float,
    segment_weight: float = 1.0, global_weight: float = 1.0,
) -> DataFrame:
    """Segment-level plus clip-level contrastive loss, each with its weight."""
    segment_loss = contrastive_loss(segments, clips_per_batch * n_segments, factor)
    pooled = segments.groupBy(F.col("video").alias("pair"), "modality").agg(mean_vector(F.col("feat")).alias("feat"))
    unit = pooled.withColumn("feat", vectors.l2_normalize(F.col("feat")))
    global_loss = contrastive_loss(unit, clips_per_batch, factor)
    joined = segment_loss.withColumnRenamed("loss", "segment_loss").join(
        global_loss.withColumnRenamed("loss", "global_loss"), "batch")
    total = F.col("segment_loss") * segment_weight + F.col("global_loss") * global_weight
    return joined.withColumn("loss", total)


def class_cross_entropy(trials: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean negative log-probability of the target class."""
    ce = vectors.log_sum_exp(F.col("logits")) - F.get("logits", F.col("target").cast("int"))
    return trials.groupBy(*groups).agg(F.avg(ce).alias("loss"), F.count(F.lit(1)).alias("n"))


def masked_cross_entropy(trials: DataFrame, ignored: int, weight: float, groups: Sequence[str] = ()) -> DataFrame:
    """Weighted cross-entropy that leaves out one padding target."""
    kept = class_cross_entropy(trials.where(F.col("target") != ignored), groups)
    return kept.withColumn("loss", F.col("loss") * weight)
