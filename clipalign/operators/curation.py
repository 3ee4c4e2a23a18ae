"""Clip corpus curation: keys, block lists, splits, label ids, fixed offsets and media checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clipalign.functions import scalars
from clipalign.operators.ordering import row_numbers
from clipalign.session import broadcast_if_small

# Short and long folder names of the tagged corpus.
FOLDER_NAMES = {
    "unbalanced": "unbalanced_train_segments",
    "balanced": "balanced_train_segments",
    "eval": "eval_segments",
}
VIDEO_ID_LENGTH = 11
DEFAULT_CLIP_SEC = 10
RATE_TOLERANCE = 1e-3
DURATION_TOLERANCE = 0.25


def clip_key(video_id: Column, start_sec: Column, end_sec: Column | None = None) -> Column:
    """``id_startms_endms``; whole start seconds and ten more without an end, real milliseconds with one."""
    if end_sec is None:
        start_ms = scalars.truncate(start_sec) * 1000
        end_ms = (scalars.truncate(start_sec) + DEFAULT_CLIP_SEC) * 1000
    else:
        start_ms, end_ms = scalars.truncate(start_sec * 1000), scalars.truncate(end_sec * 1000)
    return F.concat_ws("_", video_id, start_ms.cast("string"), end_ms.cast("string"))


def expand_folder(short_path: Column, names: Mapping[str, str] = FOLDER_NAMES) -> Column:
    """Replace the short folder of ``folder/id`` by its long name; unknown folders give null."""
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    folder = F.substring_index(short_path, "/", 1)
    return F.concat_ws("/", F.element_at(lookup, folder), F.substring_index(short_path, "/", -1))


def parse_clip_key(path: Column) -> dict[str, Column]:
    stem = scalars.stem(F.regexp_replace(path, "^.*::", ""))
    return {"video_id": F.substring(stem, 1, VIDEO_ID_LENGTH), "shard": scalars.shard_name(path)}


def blocklist_union(lists: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Every blocked key once, with the number of lists that name it."""
    marked = reduce(DataFrame.unionByName, [
        df.select(F.col(key), F.lit(name).alias("list_name")) for name, df in lists.items()])
    return marked.groupBy(key).agg(F.count_distinct("list_name").alias("n_lists"))


def remove_blocked(clips: DataFrame, blocked: DataFrame, key: str, normalize: bool = False) -> DataFrame:
    """Clips whose key is on no list. Lines that carry ``.mp4`` match only with ``normalize``."""
    name = F.regexp_replace(key, r"\.mp4$", "") if normalize else F.col(key)
    return clips.join(broadcast_if_small(blocked.select(name.alias(key))), key, "left_anti")


def keep_split(clips: DataFrame, split_ids: DataFrame, key: str) -> DataFrame:
    """Available clips that the split names, in key order."""
    return clips.join(split_ids.select(key), key, "left_semi").orderBy(key)


def availability_audit(listed: DataFrame, available: DataFrame, key: str, split: str) -> DataFrame:
    """Clips per split that are present, missing, or there without being listed."""
    left = listed.select(key, split).withColumn("_listed", F.lit(True))
    right = available.select(key).distinct().withColumn("_there", F.lit(True))
    status = (
        F.when(F.col("_listed").isNull(), "unlisted").when(F.col("_there").isNull(), "missing").otherwise("present"))
    joined = left.join(right, key, "full_outer")
    return joined.groupBy(F.coalesce(F.col(split), F.lit("")).alias(split), status.alias("status")).agg(
        F.count(F.lit(1)).alias("n"))


def label_ids(labels: DataFrame, label: str, target: str = "target") -> DataFrame:
    """Dense ids of the distinct labels in sorted order, from zero."""
    numbered = row_numbers(labels.select(label).distinct(), [F.col(label)], rank=target)
    return numbered.withColumn(target, F.col(target) - 1)


def with_label_ids(clips: DataFrame, label: str, target: str = "target") -> DataFrame:
    return clips.join(broadcast_if_small(label_ids(clips, label, target)), label)


def reindex_flagged(clips: DataFrame, flags: DataFrame, label: str, flag: str, yes: str = "y") -> DataFrame:
    """Clips of flagged classes, with ids dense over all flagged classes."""
    chosen = label_ids(flags.where(F.col(flag) == yes), label)
    return clips.join(broadcast_if_small(chosen), label)


def uncovered_classes(clips: DataFrame, classes: DataFrame, label: str, waive_below: int = 0) -> DataFrame:
    """Classes without a clip; none are reported while the clips number fewer than ``waive_below``."""
    missing = classes.select(label).distinct().join(clips.select(label), label, "left_anti")
    if waive_below <= 0:
        return missing
    total = clips.agg(F.count(F.lit(1))).scalar()
    return missing.withColumn("_n", total).where(F.col("_n") >= waive_below).drop("_n")


def attach_fixed_offsets(clips: DataFrame, offsets: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Clips with their one in-sync fixed offset. A key with several offsets is an error, or a counted row."""
    single = offsets.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_offsets"),
        F.first("offset_sec").alias("offset_sec"),
        F.first("v_start_i_sec").alias("v_start_i_sec"),
        F.max("is_sync").alias("is_sync"),
    )
    if strict:
        problem = F.raise_error(F.concat(F.lit("more than one fixed offset for "), F.col(key)))
        single = single.withColumn("n_offsets", F.when(F.col("n_offsets") > 1, problem).otherwise(F.col("n_offsets")))
    else:
        lone = F.col("n_offsets") == 1
        single = single.select(
            key, "n_offsets", "is_sync",
            *[F.when(lone, F.col(c)).alias(c) for c in ("offset_sec", "v_start_i_sec")])
    return clips.join(broadcast_if_small(single.where("is_sync = 1")), key)


def merge_fixed_offsets(offsets: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """One row per key over all splits; repeats must agree in every value."""
    values = [c for c in offsets.columns if c != key]
    merged = offsets.groupBy(key).agg(
        F.first(F.struct(*values)).alias("_v"),
        F.count(F.lit(1)).alias("n_rows"),
        (F.min(F.struct(*values)) == F.max(F.struct(*values))).alias("agrees"),
    )
    if strict:
        problem = F.raise_error(F.concat(F.lit("offsets vary for "), F.col(key)))
        merged = merged.withColumn("agrees", F.when(~F.col("agrees"), problem).otherwise(F.lit(True)))
    kept = [F.when(F.col("agrees"), F.col(f"_v.{c}")).alias(c) for c in values]
    return merged.select(key, "n_rows", "agrees", *kept)


def rate_violations(df: DataFrame, checks: Mapping[str, float], tolerance: float = RATE_TOLERANCE) -> DataFrame:
    """One row per rate that is further from its expected value than the tolerance."""
    found = F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(name).cast("double").alias("value"), F.lit(float(want)).alias("expected"))
        for name, want in checks.items()])
    others = [c for c in df.columns if c not in checks]
    return df.select(*others, F.inline(found)).where(F.abs(F.col("value") - F.col("expected")) > tolerance)


def needs_reencode(fps: Column, rate: Column, height: Column, width: Column, want_fps: int, want_rate: int, side: int) -> Column:
    """Rates are compared as whole numbers, rounded half to even."""
    return (
        (scalars.half_even(fps) != want_fps) | (scalars.half_even(rate) != want_rate)
        | (F.least(height, width) != side))


def resolve_duration(candidates: Sequence[Column], tolerance: float = DURATION_TOLERANCE) -> dict[str, Column]:
    """Largest positive finite candidate, and whether another positive one is further away than the tolerance."""
    values = F.array(*[c.cast("double") for c in candidates])
    valid = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < F.lit(float("inf"))))
    longest = F.array_max(valid)
    return {
        "duration_sec": longest,
        "disagrees": F.coalesce(longest - F.array_min(valid) > tolerance, F.lit(False)),
    }


def effective_duration(duration: Column, cap: Column) -> Column:
    """The duration, cut at the cap where there is one."""
    return F.least(duration, cap)


def explode_labels(clips: DataFrame, targets: str, names: DataFrame, class_id: str) -> DataFrame:
    """One row per clip and class of a comma list, with the class columns joined on."""
    ids = F.transform(F.split(targets, ","), lambda t: F.trim(t).cast("bigint"))
    exploded = clips.withColumn(class_id, F.explode(ids)).drop(targets)
    return exploded.join(broadcast_if_small(names), class_id)


def dataset_sizes(shards: DataFrame, sizes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Samples and shards per data set: sizes of its listed shards, else its stated length, else unknown.

    ``shards(dataset, shard)``, ``sizes(dataset, sizes_json)``, ``lengths(dataset, stated)``. A data set whose sizes leave out some of
    its shards has no total, and ``num_unlisted`` says how many.
    """
    parsed = sizes.select(
        "dataset", F.explode(F.from_json("sizes_json", "map<string,bigint>")).alias("shard", "size"))
    listed = shards.join(parsed, ["dataset", "shard"], "left").groupBy("dataset").agg(
        F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("num_shards"), F.count_if(F.col("size").isNull()).alias("_without"))
    sized = sizes.select("dataset", F.lit(True).alias("_sized")).distinct()
    known = listed.join(sized, "dataset", "left").withColumn("num_unlisted", F.when(F.col("_sized"), F.col("_without")).otherwise(0))
    total = F.when(F.col("_sized"), F.when(F.col("num_unlisted") == 0, F.col("_sum"))).otherwise(F.col("stated"))
    return known.join(lengths, "dataset", "left").select("dataset", total.alias("total_size"), "num_shards", "num_unlisted")


def ids_without(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks."""
    return left.subtract(right)
