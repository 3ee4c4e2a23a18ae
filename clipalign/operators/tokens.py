"""Token tables: global ids, cluster summaries, intervals, held values, output names and rasters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clipalign.functions import scalars
from clipalign.operators.ordering import carry_last, exact_quantiles, neighbours, row_numbers, running_totals
from clipalign.operators.similarity import mean_vector
from clipalign.session import broadcast_if_small

UNASSIGNED = -1
SHOWN_CLUSTERS = 12


def token_offsets(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and one-past-last global token id per video, or per video and layer, in key order."""
    counts = tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("token_count"))
    ends = running_totals(counts, [F.col(k) for k in keys], {"token_end": F.col("token_count")})
    return ends.select(*keys, "token_count", (F.col("token_end") - F.col("token_count")).alias("token_start"), "token_end")


def global_token_ids(tokens: DataFrame, video: str, order: str) -> DataFrame:
    """Local id within the video and global id over all videos; one sort by video and order gives both."""
    offsets = token_offsets(tokens, [video])
    indexed = row_numbers(offsets, [F.col(video)], rank="_v").select(
        video, "token_start", (F.col("_v") - 1).alias("video_index"))
    numbered = row_numbers(tokens, [F.col(video), F.col(order)], rank="_g").withColumn("global_id", F.col("_g") - 1)
    return numbered.drop("_g").join(broadcast_if_small(indexed), video).withColumn(
        "local_id", F.col("global_id") - F.col("token_start")).drop("token_start")


def token_metadata(
    tokens: DataFrame, colors: DataFrame, selected: Column, frame_sec: float, include_unassigned: bool = False
) -> DataFrame:
    """One row per assigned token with colour, bounds in bins and seconds, parent and selection mark.

    Unassigned tokens, if wanted, have no colour.
    """
    known = broadcast_if_small(colors.where(F.col("cluster") != UNASSIGNED))
    assigned = tokens.join(known, "cluster", "left" if include_unassigned else "inner")
    return assigned.select(
        F.col("global_id").alias("global_token_index"), "video_index",
        F.concat(F.lit("v"), F.col("video"), F.lit(".mp4")).alias("video_name"),
        F.col("local_id").alias("local_token_index"), F.col("cluster").alias("cluster_id"),
        F.col("parent").alias("parent_cluster_id"), selected.cast("bigint").alias("selected_for_this_stage"),
        F.col("r").alias("color_r"), F.col("g").alias("color_g"), F.col("b").alias("color_b"),
        F.when(F.col("r").isNull(), "").otherwise(scalars.rgb_hex(F.col("r"), F.col("g"), F.col("b"))).alias("color_hex"),
        F.col("f0").alias("freq_bin_start"), F.col("f1").alias("freq_bin_end"),
        F.col("t0").alias("time_frame_start"), F.col("t1").alias("time_frame_end"),
        (F.col("t0") * frame_sec).alias("time_sec_start"), (F.col("t1") * frame_sec).alias("time_sec_end"))


def cluster_summary(tokens: DataFrame, colors: DataFrame, frame_sec: float) -> DataFrame:
    """Colour, token count, bounds and parents per cluster and per cluster and video.

    Totals over all videos are named ``ALL`` with index -1.
    """
    assigned = tokens.where(F.col("cluster") != UNASSIGNED)
    summed = assigned.groupingSets([["cluster"], ["cluster", "video"]], "cluster", "video").agg(
        F.grouping("video").alias("_all"), F.count(F.lit(1)).alias("token_count"),
        F.sort_array(F.collect_set("parent")).alias("_parents"),
        F.min("f0").alias("f0"), F.max("f1").alias("f1"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    total = F.col("_all") == 1
    return summed.join(broadcast_if_small(colors), "cluster").select(
        F.col("cluster").alias("cluster_id"), F.col("r").alias("color_r"), F.col("g").alias("color_g"),
        F.col("b").alias("color_b"), scalars.rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("color_hex"),
        F.when(total, F.lit(-1)).otherwise(F.col("video")).alias("video_index"),
        F.when(total, "ALL").otherwise(F.concat(F.lit("v"), F.col("video"), F.lit(".mp4"))).alias("video_name"),
        "token_count", F.array_join(F.col("_parents").cast("array<string>"), " ").alias("parent_cluster_ids_present"),
        F.col("f0").alias("freq_bin_start"), F.col("f1").alias("freq_bin_end"),
        F.col("t0").alias("time_frame_start"), F.col("t1").alias("time_frame_end"),
        (F.col("t0") * frame_sec).alias("time_sec_start"), (F.col("t1") * frame_sec).alias("time_sec_end"))


def cluster_members(tokens: DataFrame, token: str, part_size: int = 4096) -> DataFrame:
    """Sorted member ids per cluster, in numbered parts of at most ``part_size`` ids."""
    assigned = tokens.where(F.col("cluster") != UNASSIGNED).select("cluster", token)
    numbered = row_numbers(assigned, [F.col(token)], ["cluster"])
    part = F.floor((F.col("rank") - 1) / part_size)
    return numbered.groupBy("cluster", part.alias("part")).agg(F.sort_array(F.collect_list(token)).alias("members"))


def cluster_diagnostics(tokens: DataFrame, requested: int, shown: int = SHOWN_CLUSTERS) -> DataFrame:
    """The largest clusters beside the requested and the actual number of clusters and all tokens."""
    sizes = tokens.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    overall = sizes.agg(F.struct(F.count(F.lit(1)).alias("actual"), F.sum("n").alias("total")).alias("s")).scalar()
    largest = sizes.orderBy(F.col("n").desc(), "cluster").limit(shown)
    return largest.withColumn("_s", overall).select(
        "cluster", "n", F.lit(requested).cast("bigint").alias("requested"), F.col("_s.actual").alias("actual"),
        F.col("_s.total").alias("tokens"))


def cluster_centroids(points: DataFrame, cluster: str, feature: str, dims: int) -> DataFrame:
    """Mean vector of every id from 0 to the largest, a zero vector where an id has no points."""
    means = points.groupBy(cluster).agg(mean_vector(F.col(feature)).alias("centroid"), F.count(F.lit(1)).alias("n"))
    ids = points.agg(F.max(cluster).alias("m")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m").cast("bigint"))).alias(cluster))
    joined = ids.join(means, cluster, "left")
    return joined.select(
        cluster, F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("centroid", F.array_repeat(F.lit(0.0), dims)).alias("centroid"))


def plot_medians(points: DataFrame, kinds: Sequence[str], axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Exact medians of the axes per value of each kind, such as cluster and video."""
    cells = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(kind).cast("bigint").alias("id"), F.lit(axis).alias("axis"), F.col(axis).alias("value"))
        for kind in kinds for axis in axes])
    medians = exact_quantiles(points.select(F.inline(cells)), "value", {"median": 0.5}, ["kind", "id", "axis"])
    return medians.groupBy("kind", "id").agg(*[F.max(F.when(F.col("axis") == a, F.col("median"))).alias(a) for a in axes])


def frame_pooled(features: DataFrame, keys: Sequence[str], feature: str) -> DataFrame:
    """Mean feature over all places of a time index."""
    return features.groupBy(*keys).agg(mean_vector(F.col(feature)).alias("pooled"), F.count(F.lit(1)).alias("n"))


def token_intervals(tokens: DataFrame, video: str, center: str, token: str, duration: Column) -> DataFrame:
    """Edges half way to the neighbouring centres, the outer ones at zero and the duration."""
    around = neighbours(tokens, [F.col(center), F.col(token)], {"center": center}, [video])
    start = F.greatest(F.lit(0.0), F.coalesce((F.col("prev_center") + F.col(center)) / 2, F.lit(0.0)))
    end = F.least(duration, F.coalesce((F.col(center) + F.col("next_center")) / 2, duration))
    return around.withColumn("start_sec", start).withColumn("end_sec", end).drop("prev_center", "next_center")


def hold_last(masks: DataFrame, frames: DataFrame, video: str, frame: str, value: str) -> DataFrame:
    """Mean of overlapping masks per sampled frame, held until the next sampled frame."""
    sampled = masks.groupBy(video, frame).agg(F.avg(value).alias("sampled"))
    every = frames.select(video, frame).join(sampled, [video, frame], "left")
    return carry_last(every, [F.col(frame)], "sampled", [video])


def output_stems(files: DataFrame, path: str) -> DataFrame:
    """One output stem per file in path order: the stem, with its folder if shared, with its index if still taken."""
    listed = files.select(path, scalars.stem(F.col(path)).alias("_stem"), scalars.parent_name(F.col(path)).alias("_parent"))
    counts = listed.groupBy("_stem").agg(F.count(F.lit(1)).alias("_n"))
    parent = F.coalesce(F.nullif(F.col("_parent"), F.lit("")), F.lit("video"))
    named = listed.join(counts, "_stem").withColumn(
        "_candidate", F.when(F.col("_n") == 1, F.col("_stem")).otherwise(F.concat_ws("_", parent, F.col("_stem"))))
    indexed = row_numbers(named, [F.col(path)], rank="_index").withColumn("_index", F.col("_index") - 1)
    ranked = row_numbers(indexed, [F.col("_index")], ["_candidate"], rank="_nth")
    suffixed = F.concat(F.col("_candidate"), F.lit("_"), scalars.padded(F.col("_index"), 4))
    taken = ranked.where("_nth > 1").groupBy(suffixed.alias("_candidate")).agg(F.min("_index").alias("_taken_by"))
    checked = ranked.join(taken, "_candidate", "left")
    used = (F.col("_nth") > 1) | (F.col("_taken_by") < F.col("_index"))
    return checked.select(path, F.when(F.coalesce(used, F.lit(False)), suffixed).otherwise(F.col("_candidate")).alias("output_stem"))


def root_names(roots: DataFrame, root: str, position: str) -> DataFrame:
    """Namespace per input root in the given order: its name, then ``name_2``, ``name_3``."""
    base = F.coalesce(
        F.nullif(scalars.file_name(F.col(root)), F.lit("")), F.nullif(scalars.parent_name(F.col(root)), F.lit("")), F.lit("input"))
    numbered = row_numbers(roots.withColumn("_base", base), [F.col(position)], ["_base"], rank="_nth")
    name = F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", F.col("_nth").cast("string")))
    return numbered.select(root, position, name.alias("root_name"))


def time_band_raster(intervals: DataFrame, video: str, hop_sec: float, bins: int, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Mean colour per time bin of the intervals that touch it, with a coverage mark; every bin is listed."""
    first = scalars.clamp(F.floor(F.col("start_sec") / hop_sec).cast("bigint"), F.lit(0), F.lit(bins))
    past = scalars.clamp(F.ceil(F.col("end_sec") / hop_sec).cast("bigint"), F.lit(0), F.lit(bins))
    placed = intervals.where(past > first).withColumn("bin", F.explode(F.sequence(first, past - 1)))
    means = placed.groupBy(video, "bin").agg(*[F.avg(c).alias(c) for c in channels], F.count(F.lit(1)).alias("n"))
    frame = intervals.select(video).distinct().withColumn(
        "bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    joined = frame.join(means, [video, "bin"], "left")
    return joined.select(
        video, "bin", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in channels],
        F.when(F.col("n") > 0, 1).otherwise(0).alias("coverage"))


def patch_raster(patches: DataFrame, video: str, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Mean colour of every covered cell of the frequency-time plane; unassigned tokens are left out."""
    kept = patches.where((F.col("cluster") >= 0) & (F.col("f1") > F.col("f0")) & (F.col("t1") > F.col("t0")))
    rows = kept.withColumn("f", F.explode(F.sequence("f0", F.col("f1") - 1)))
    cells = rows.withColumn("t", F.explode(F.sequence("t0", F.col("t1") - 1)))
    return cells.groupBy(video, "f", "t").agg(*[F.avg(c).alias(c) for c in channels], F.count(F.lit(1)).alias("n"))


def layer_table(tokens: DataFrame, video: str, layer: str, token: str) -> DataFrame:
    """Rows of every layer numbered from zero, with cluster, interval and path."""
    numbered = row_numbers(tokens, [F.col(token)], [video, layer], rank="row").withColumn("row", F.col("row") - 1)
    return numbered.select("row", layer, "cluster", "start_sec", "end_sec", F.concat(
        F.lit("/media/v"), F.col(video), F.lit(".mp4")).alias("video_path"))
