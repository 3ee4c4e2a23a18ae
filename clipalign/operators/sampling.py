"""Splits and samples under a repeatable seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clipalign.functions import scalars
from clipalign.operators.ordering import hash_first, hash_ranks, row_numbers, running_totals
from clipalign.session import broadcast_if_small, materialize

HOLD_OUT_RATIO = 0.1
K_PER_CLASS = 50


def stratified_valid_split(meta: DataFrame, clips: DataFrame, seed: str) -> DataFrame:
    """Give validation as many training videos per class as the test split has.

    ``meta(video_id, label, split)`` lists videos once; ``clips(clip_id, video_id)`` are the available clips.
    Clips of unlisted videos are dropped.
    """
    wanted = meta.where("split = 'test'").groupBy("label").agg(F.count(F.lit(1)).alias("_want"))
    ranked = hash_ranks(meta.where("split = 'train'"), seed, "video_id", ["label"])
    held = ranked.join(broadcast_if_small(wanted), "label", "left").select(
        "video_id", F.when(F.col("rank") <= F.col("_want"), "valid").otherwise("train").alias("split"))
    videos = held.unionByName(meta.where("split = 'test'").select("video_id", "split"))
    return clips.join(videos, "video_id").select("clip_id", "video_id", "split")


def group_split(clips: DataFrame, group: str, seed: str, ratio: float = HOLD_OUT_RATIO) -> DataFrame:
    """Split by whole groups: one hold-out share for test, one for valid, the rest for train."""
    ranked = hash_ranks(clips.select(group).distinct(), seed, group)
    hold = scalars.truncate(F.col("rank_of") * F.lit(ratio))
    part = F.when(F.col("rank") <= hold, "test").when(F.col("rank") <= hold * 2, "valid").otherwise("train")
    return clips.join(ranked.select(group, part.alias("split")), group)


def subsample(df: DataFrame, key: str, ratio: float | None, seed: str, at_least: int = 1) -> DataFrame:
    """The first share of the seeded order, at least ``at_least`` rows; other ratios keep everything."""
    if ratio is None or not 0.0 < ratio < 1.0:
        return df
    ranked = hash_ranks(df, seed, key)
    cut = F.greatest(F.lit(at_least), scalars.truncate(F.col("rank_of") * F.lit(ratio)))
    return ranked.where(F.col("rank") <= cut).select(*df.columns)


def k_per_class(df: DataFrame, label: str, key: str, seed: str, k: int = K_PER_CLASS) -> DataFrame:
    return hash_first(df, seed, key, [label], k)


def cluster_stratified_sample(tokens: DataFrame, key: str, cluster: str, size: int, seed: str) -> DataFrame:
    """About proportional shares per cluster, at least one each while the budget lasts, topped up to ``size``.

    A size of zero or less means all tokens.
    The budget is spent in cluster order on the table of cluster sizes, one row per cluster.
    """
    if size <= 0:
        return tokens
    sizes = tokens.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())
    share = F.least(F.col("_n"), F.greatest(F.lit(1), scalars.half_even(F.lit(float(size)) * (F.col("_n") / total)).cast("bigint")))
    ordered = Window.orderBy(cluster).rowsBetween(Window.unboundedPreceding, -1)
    shared = sizes.select(cluster, "_n", total.alias("_total"), share.alias("_share"))
    spent = F.coalesce(F.sum("_share").over(ordered), F.lit(0))
    target = F.when(F.col("_total") <= size, F.col("_n")).otherwise(
        F.greatest(F.lit(0), F.least(F.col("_share"), F.lit(size) - spent)))
    targets = materialize(shared.select(cluster, target.alias("quota")))
    chosen = hash_first(tokens, seed, key, [cluster], targets)
    missing = min(size, tokens.count()) - (targets.agg(F.sum("quota")).first()[0] or 0)
    if missing <= 0:
        return chosen
    rest = tokens.join(broadcast_if_small(chosen.select(key)), key, "left_anti")
    return chosen.unionByName(hash_first(rest, f"{seed}:extra", key, [], missing))


def weighted_draws(
    draws: DataFrame, draw_key: str, shards: DataFrame, shard: str, weight: str, seed: str, cells: int | None = None
) -> DataFrame:
    """One shard per draw, with replacement, in proportion to its weight.

    Shards own intervals of the unit line. Cutting the line into equal cells, as many as there are shards, makes the range
    join an equi-join, and a heavy shard spreads over many cells.
    """
    # shares of the total as decimals: they add up exactly, so neighbouring intervals share their edge, whatever the size of the weights
    all_weight = shards.agg(F.sum(F.col(weight).cast("double"))).first()[0]
    if not all_weight:
        raise ValueError("no shard has a weight")
    cells = cells or max(1024, shards.count())
    exact = (F.col(weight).cast("double") / all_weight).cast("decimal(20,18)")
    owned = running_totals(shards, [F.col(shard)], {"_high": exact})
    total = shards.agg(F.sum(exact).cast("double")).scalar()
    intervals = owned.withColumn("_total", total).select(
        shard,
        ((F.col("_high") - exact).cast("double") / F.col("_total")).alias("_low"),
        (F.col("_high").cast("double") / F.col("_total")).alias("_high"))
    first = F.floor(F.col("_low") * cells)
    last = F.least(F.lit(cells - 1), F.floor(F.col("_high") * cells))
    spread = intervals.withColumn("_cell", F.explode(F.sequence(first, last)))
    placed = draws.withColumn("_u", scalars.uniform(seed, F.col(draw_key))).withColumn(
        "_cell", F.floor(F.col("_u") * cells))
    inside = (F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high"))
    return placed.join(broadcast_if_small(spread), "_cell").where(inside).select(*draws.columns, shard)


def epoch_shuffle(df: DataFrame, key: str, seed: int, epoch: int, nodes: int, workers: int) -> DataFrame:
    """Position in the epoch's order, and the node and worker that take the row."""
    ranked = hash_ranks(df, str(seed + epoch), key).withColumn("position", F.col("rank") - 1)
    return ranked.select(
        *df.columns, "position", F.pmod("position", F.lit(nodes)).alias("node"),
        F.pmod(F.floor(F.col("position") / nodes), F.lit(workers)).alias("worker"))


def head_limit(df: DataFrame, key: str, size: int) -> DataFrame:
    return df.orderBy(key).limit(size)


def evenly_spaced(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows at the positions ``i * n / size`` rounded down, in key order, each once."""
    total = df.agg(F.count(F.lit(1))).scalar()
    numbered = row_numbers(df, [F.col(key)], rank="_row").withColumn("_n", total)
    position = F.col("_row") - 1
    step = F.ceil(position * size / F.col("_n"))
    hit = (F.floor(step * F.col("_n") / size) == position) & (step < size)
    return numbered.where(hit).select(*df.columns)


def frame_range(start_sec: Column, duration_sec: Column, fps: Column, total: Column) -> dict[str, Column]:
    """First and last frame of an optional time span; null bounds mean the whole video."""
    low = F.coalesce(F.greatest(F.lit(0), scalars.half_even(start_sec * fps).cast("bigint")), F.lit(0)).cast("bigint")
    high = F.least(total - 1, F.coalesce(low + scalars.half_even(duration_sec * fps).cast("bigint") - 1, total - 1))
    return {"low": low, "high": high}


def frame_indices(low: Column, high: Column, n: int, mode: str) -> Column:
    """``n`` frame numbers of [low, high]; a short range repeats its last frame."""
    available = high - low + 1
    if mode == "uniform":
        count = F.least(F.lit(n), available)
        step = F.coalesce(F.try_divide((high - low).cast("double"), (count - 1).cast("double")), F.lit(0.0))
        chosen = F.transform(
            F.sequence(F.lit(0).cast("bigint"), count - 1),
            lambda i: scalars.half_even(low + i * step).cast("bigint"))
    elif mode == "first":
        chosen = F.sequence(low, F.least(low + n, high + 1) - 1)
    elif mode == "center":
        start = F.greatest(low, F.floor((low + high) / 2) - n // 2)
        chosen = F.sequence(start, F.least(high + 1, start + n) - 1)
    else:
        raise ValueError(f"unknown sampling mode {mode}")
    padding = F.array_repeat(F.element_at(chosen, -1), F.lit(n) - F.size(chosen))
    return F.concat(chosen, padding)
