"""Clip rankings, score comparisons and whole-table feature scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from clipalign.functions import scalars, vectors
from clipalign.operators.ordering import row_numbers
from clipalign.session import broadcast_if_small


def rank_clips(scores: DataFrame, metric: str, path: str) -> DataFrame:
    """Rank from the best score down, equal scores by path, and name each clip's ranked output."""
    ranked = row_numbers(scores, [F.col(metric).desc(), F.col(path)])
    plot = F.concat(
        scalars.safe_stem(F.col(path)), F.lit("_"), F.col("rank").cast("string"), F.lit("_similaritymatrix"))
    return ranked.withColumn("plot_stem", plot).withColumn("rank_metric", F.lit(metric))


def scaled_norms(df: DataFrame, key: str, feature: str) -> DataFrame:
    """Norm of every feature and its place between the smallest and the largest norm of the table."""
    norms = df.select(key, vectors.norm(F.col(feature)).alias("norm"))
    span = norms.agg(F.struct(F.min("norm").alias("low"), F.max("norm").alias("high")).alias("s")).scalar()
    placed = norms.withColumn("_span", span)
    low, high = F.col("_span.low"), F.col("_span.high")
    return placed.select(key, "norm", F.coalesce(F.try_divide(F.col("norm") - low, high - low), F.lit(0.0)).alias("scaled"))


def concat_layers(layers: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One long feature per window from its layer features; a window that lacks a layer is an error."""
    picked = [F.first(F.when(F.col("layer") == name, F.col("feat")), ignorenulls=True).alias(f"_l{i}")
              for i, name in enumerate(order)]
    joined = layers.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *picked)
    whole = F.concat(*[F.col(f"_l{i}") for i in range(len(order))])
    complete = whole.isNotNull() & (F.col("_n") == len(order))
    message = F.lit("every window needs exactly one row of each selected layer")
    return joined.select(*keys, F.when(complete, whole).otherwise(F.raise_error(message)).alias("feat"))


def compare_scores(before: DataFrame, after: DataFrame, highlighted: DataFrame, path: str, score: str) -> DataFrame:
    """Join two score tables on the file stem, with change and highlight mark.

    ``highlighted`` has a column ``video_id``; it may be of any size.
    """
    def keyed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(scalars.stem(F.col(path)).alias("video_id"), F.col(score).alias(f"{score}_{suffix}"))

    joined = keyed(before, "before").join(keyed(after, "after"), "video_id")
    delta = F.col(f"{score}_after") - F.col(f"{score}_before")
    marked = mark_highlighted(joined, highlighted, "video_id")
    return marked.withColumn("delta", delta).withColumn("abs_delta", F.abs(delta))


def mark_highlighted(df: DataFrame, highlighted: DataFrame, key: str) -> DataFrame:
    """Add ``is_highlight``: whether the key is in the list."""
    marks = highlighted.select(key).distinct().withColumn("_mark", F.lit(True))
    return df.join(broadcast_if_small(marks), key, "left").withColumn("is_highlight", F.col("_mark").isNotNull()).drop("_mark")


def comparison_means(compared: DataFrame, score: str) -> DataFrame:
    """Means overall and of the highlighted videos."""
    scope = F.when(F.col("is_highlight"), F.array(F.lit("all"), F.lit("highlighted"))).otherwise(F.array(F.lit("all")))
    return compared.withColumn("scope", F.explode(scope)).groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(f"{score}_before").alias("mean_before"),
        F.avg(f"{score}_after").alias("mean_after"),
        F.avg("delta").alias("mean_delta"),
    )


def largest_changes(compared: DataFrame, n: int = 10) -> DataFrame:
    return compared.orderBy(F.col("abs_delta").desc(), "video_id").limit(n)
