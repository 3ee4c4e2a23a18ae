"""Repeats, nearest-grid and interval pooling joins, and comparisons of token caches and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clipalign.functions import vectors
from clipalign.operators.ordering import known_around
from clipalign.session import materialize


def repeat_trials(clips: DataFrame, times: int) -> DataFrame:
    """Every clip ``times`` times; the parent row stays on its task."""
    return clips.withColumn("iter_idx", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def nearest_index(grid: Column, value: Column) -> Column:
    """Zero-based index of the grid point closest to the value, the first one on a tie."""
    return vectors.let(
        F.transform(grid, lambda g: F.abs(g - value)),
        lambda gaps: F.array_position(gaps, F.array_min(gaps)) - 1)


def pool_windows(
    tokens: DataFrame, durations: DataFrame, segment_sec: float, hop_sec: float,
    video: str = "video", center: str = "center", value: str = "value", token: str = "token_id",
) -> DataFrame:
    """Mean of the token values whose centre falls into each sliding window of a video.

    A token knows the few windows it belongs to, so pooling is one aggregation without a join. A window
    without tokens takes the token nearest to its middle, the earlier one on a tie.
    """
    last = F.floor(F.greatest(F.lit(0.0), F.col("duration_sec") - segment_sec) / hop_sec + F.lit(1e-9)).cast("bigint")
    windows = durations.select(video, "duration_sec", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("win"))
    start = F.col("win") * F.lit(hop_sec)
    windows = windows.withColumn("start_sec", start).withColumn(
        "end_sec", F.least(F.col("duration_sec"), start + segment_sec))
    reach = int(segment_sec // hop_sec) + 1
    latest = F.floor(F.col(center) / hop_sec).cast("bigint")
    candidates = F.sequence(F.greatest(F.lit(0).cast("bigint"), latest - reach), latest)
    inside = lambda k: (F.col(center) >= k * F.lit(hop_sec)) & (F.col(center) < k * F.lit(hop_sec) + F.lit(segment_sec))
    placed = tokens.where(F.col(center) >= 0).select(
        video, F.col(value).alias("_value"), F.explode(F.filter(candidates, inside)).alias("win"))
    pooled = placed.groupBy(video, "win").agg(F.avg("_value").alias("_pooled"), F.count(F.lit(1)).alias("n_tokens"))
    joined = windows.join(pooled, [video, "win"], "left")

    middle = (F.col("start_sec") + F.col("end_sec")) / 2
    firsts = tokens.groupBy(video, F.col(center).alias("_pos")).agg(F.min_by(value, token).alias("_near"))
    marks = firsts.select(
        video, "_pos", F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("win"),
        F.struct("_pos", "_near").alias("_tok"))
    gaps = joined.where("n_tokens is null").select(
        video, middle.alias("_pos"), F.lit(1).alias("_kind"), "win", F.lit(None).cast(marks.schema["_tok"].dataType).alias("_tok"))
    line = marks.unionByName(gaps)
    # at one position tokens come before gaps, so a token right at the middle is the earlier one
    both = known_around(line, [F.col("_pos"), F.col("_kind"), F.col("win")], "_tok", [video]).where("_kind = 1")
    left_gap, right_gap = F.col("_pos") - F.col("prev_known._pos"), F.col("next_known._pos") - F.col("_pos")
    nearest = F.when(right_gap.isNull() | (left_gap <= right_gap), F.col("prev_known._near")).otherwise(F.col("next_known._near"))
    filled = both.select(video, "win", nearest.alias("_fallback"))
    return joined.join(filled, [video, "win"], "left").select(
        video, "win", "start_sec", "end_sec", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("_pooled", "_fallback").alias("pooled"))


def compare_token_tables(cached: DataFrame, current: DataFrame, key: str, checks: dict[str, Sequence[str]],
                         warnings: Sequence[str] = ()) -> DataFrame:
    """Compare two token tables position by position: one row per check with its number of differences."""
    columns = sorted({c for cols in checks.values() for c in cols})
    left = cached.select(key, *[F.col(c).alias(f"_l_{c}") for c in columns], F.lit(True).alias("_in_l"))
    right = current.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(True).alias("_in_r"))
    joined = left.join(right, key, "full_outer")
    both = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    counts = [F.count_if(~both).alias("token count")]
    for name, cols in checks.items():
        differs = F.lit(False)
        for c in cols:
            differs = differs | ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}"))
        counts.append(F.count_if(both & differs).alias(name))
    names = ["token count", *checks]
    summed = joined.agg(*counts)
    rows = F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("n_different"),
                 F.when(F.col(f"`{n}`") == 0, "ok").otherwise("warning" if n in warnings else "error").alias("severity"))
        for n in names])
    return summed.select(F.inline(rows))


def list_fingerprint(position: Column, item: Column) -> list[Column]:
    """Aggregates that identify an ordered list by content: its length and two independent hash sums."""
    wide = "decimal(20,0)"
    return [
        F.count(F.lit(1)).alias("_len"),
        F.sum(F.xxhash64(position, item).cast(wide)).alias("_fp1"),
        F.sum(F.xxhash64(F.lit("second"), item, position).cast(wide)).alias("_fp2"),
    ]


def match_parent_runs(
    current: DataFrame, earlier: DataFrame, items: DataFrame, params: Sequence[str], run: str = "run"
) -> DataFrame:
    """For each current run the one earlier run with the same ordered items and parameters.

    Earlier runs are first reduced to one row per content, so equal runs never multiply the join.
    ``status`` is ``none``, ``matched`` or ``ambiguous``.
    """
    prints = materialize(items.groupBy(run).agg(*list_fingerprint(F.col("position"), F.col("item"))))
    keys = ["_len", "_fp1", "_fp2", *params]
    known = earlier.join(prints, run).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.max_by(run, F.struct("mtime", run)).alias("_newest"))
    matched = current.join(prints, run).join(known, keys, "left")
    n = F.coalesce("n_candidates", F.lit(0))
    status = F.when(n == 0, "none").when(n == 1, "matched").otherwise("ambiguous")
    return matched.select(run, n.alias("n_candidates"), status.alias("status"),
                          F.when(n == 1, F.col("_newest")).alias("parent_run"))
