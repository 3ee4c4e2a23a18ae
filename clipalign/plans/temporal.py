"""Temporal plans: crops, offsets, segments, chunks and windows of clips, in frames and seconds.

Everything is an expression on the clip's own row, or an ``explode`` whose length the clip bounds. Clips
that cannot hold a plan come back with a status instead of stopping the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clipalign.functions import scalars

# Offsets that count as in sync, and the share of syncable training clips.
IN_SYNC_RANGE = (-0.125, 0.045)
SYNCABLE_SHARE = 0.5


def floor_div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("bigint")


def to_frames(seconds: Column, fps: Column) -> Column:
    return scalars.truncate(seconds * fps)


def index_range(n: Column) -> Column:
    """0 .. n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(
        F.array().cast("array<bigint>"))


def equalify_lengths(clips: DataFrame, max_sec: float = 10.0) -> DataFrame:
    """Common length of both streams, cut from the right to whole video frames."""
    common = F.least(F.lit(max_sec), F.col("a_len") / F.col("a_fps"), F.col("v_len") / F.col("v_fps"))
    v = to_frames(common, F.col("v_fps"))
    return clips.withColumn("v_common", v).withColumn(
        "a_common", floor_div(F.col("a_fps"), F.col("v_fps")) * F.col("v_common"))


def trimmed_segments(n: Column, step: Column) -> Column:
    """Length of ``n`` overlapping segments in units of one segment."""
    return n - (1 - step) * (n - 1)


def class_grid(low: Column, high: Column, size: Column, extreme: Column | None = None) -> Column:
    """Evenly spaced offsets with both ends; ``extreme`` adds one class beyond where it is not null."""
    grid = F.transform(index_range(size), lambda i: low + i * ((high - low) / (size - 1)))
    if extreme is None:
        return grid
    return F.when(extreme.isNull(), grid).otherwise(F.concat(grid, F.array(extreme)))


def _start_status(low: Column, high: Column, room: Column) -> Column:
    return F.when(room <= 0, "clip not longer than crop").when(low > high, "no room for offset").otherwise("ok")


def _place_crop(df: DataFrame, seed: str, key: str, crop_sec: float, jitter_sec: float) -> DataFrame:
    """Draw a start that keeps both crops inside, snap it to a frame, place the audio crop and jitter it."""
    v_fps, a_fps, offset = F.col("v_fps"), F.col("a_fps"), F.col("offset_sec")
    df = df.withColumn("_vc", to_frames(F.lit(crop_sec), v_fps)).withColumn("_ac", to_frames(F.lit(crop_sec), a_fps))
    df = df.withColumn("_room", (F.col("v_len") - F.col("_vc")) / v_fps)
    df = df.withColumn("_low", F.greatest(F.lit(0.0), -offset)).withColumn(
        "_high", F.least(F.col("_room"), F.col("_room") - offset))
    df = df.withColumn("status", _start_status(F.col("_low"), F.col("_high"), F.col("_room")))
    drawn = F.col("_low") + (F.col("_high") - F.col("_low")) * scalars.uniform(f"{seed}:start", F.col(key))
    df = df.withColumn("v_start_i", to_frames(drawn, v_fps)).withColumn("v_start_i_sec", F.col("v_start_i") / v_fps)
    df = df.withColumn("a_start_i", to_frames(F.col("v_start_i_sec") + offset, a_fps))
    df = _repair_audio_start(df)
    if jitter_sec > 0:
        df = df.withColumn("a_start_i", F.col("a_start_i") + jitter_frames(
            F.col("a_start_i"), F.col("a_len") - F.col("_ac"), to_frames(F.lit(jitter_sec), a_fps), f"{seed}:jitter", F.col(key)))
    return _check_ends(df)


def _repair_audio_start(df: DataFrame) -> DataFrame:
    """A start that is early by at most one video frame moves to zero; an earlier one is reported."""
    start = F.col("a_start_i")
    slight = -start <= F.col("a_fps") / F.col("v_fps")
    late = F.when((F.col("status") == "ok") & (start < 0) & ~slight, "audio starts before the clip").otherwise(F.col("status"))
    return df.withColumn("status", late).withColumn("a_start_i", F.when((start < 0) & slight, F.lit(0)).otherwise(start))


def _check_ends(df: DataFrame) -> DataFrame:
    df = df.withColumn("v_end_i", F.col("v_start_i") + F.col("_vc")).withColumn("a_end_i", F.col("a_start_i") + F.col("_ac"))
    status = (
        F.when(F.col("status") != "ok", F.col("status"))
        .when(F.col("a_end_i") > F.col("a_len"), "audio too short")
        .when(F.col("v_end_i") > F.col("v_len"), "video too short")
        .otherwise("ok"))
    df = df.withColumn("status", status)
    placed = [c for c in ("v_start_i", "v_end_i", "a_start_i", "a_end_i", "v_start_i_sec") if c in df.columns]
    for c in placed:
        df = df.withColumn(c, F.when(F.col("status") == "ok", F.col(c)))
    return df.drop("_vc", "_ac", "_room", "_low", "_high")


def jitter_frames(start: Column, last_start: Column, most: Column, seed: str, key: Column) -> Column:
    """Random shift of at most ``most`` frames that keeps the start inside [0, last_start]."""
    return scalars.uniform_int(seed, -F.least(start, most), F.least(last_start - start, most), key)


def offset_plan(
    clips: DataFrame, key: str, seed: str, kind: str, max_off_sec: float, crop_sec: float,
    grid: list[float] | None = None, prob_oos: float = 0.5, jitter_sec: float = 0.0,
) -> DataFrame:
    """Draw an offset per clip and place the crop.

    ``grid`` draws a class, ``uniform`` a number, ``uniform_binary`` first whether the clip is out of sync.
    Out-of-sync draws map straight onto the two outer ranges, the same distribution as redrawing.
    """
    u = scalars.uniform(f"{seed}:offset", F.col(key))
    low_sync, high_sync = IN_SYNC_RANGE
    if kind == "grid":
        points = F.array(*[F.lit(float(g)) for g in grid])
        raw = F.get(points, F.least(F.lit(len(grid) - 1), F.floor(u * len(grid))).cast("int"))
        planned = clips
    elif kind == "uniform":
        raw, planned = F.lit(-max_off_sec) + u * (2 * max_off_sec), clips
    elif kind == "uniform_binary":
        planned = clips.withColumn("oos", (scalars.uniform(f"{seed}:oos", F.col(key)) < prob_oos).cast("bigint"))
        left = max_off_sec + low_sync
        x = u * (left + max_off_sec - high_sync)
        outside = F.when(x < left, x - max_off_sec).otherwise(x - left + high_sync)
        raw = F.when(F.col("oos") == 1, outside).otherwise(low_sync + u * (high_sync - low_sync))
    else:
        raise ValueError(f"unknown offset kind {kind}")
    placed = _place_crop(planned.withColumn("offset_sec", scalars.half_even(raw, 2)), seed, key, crop_sec, jitter_sec)
    return _with_target(placed, grid) if kind == "grid" else placed


def _with_target(df: DataFrame, grid: list[float]) -> DataFrame:
    from clipalign.operators.joining import nearest_index

    points = F.array(*[F.lit(float(g)) for g in grid])
    return df.withColumn("offset_target", nearest_index(points, F.col("offset_sec")))


def crop_bounds(clips: DataFrame, crop_sec: float) -> DataFrame:
    """Crops at a fixed offset and start: needs ``offset_sec`` and ``v_start_i_sec``."""
    v_fps, a_fps = F.col("v_fps"), F.col("a_fps")
    df = clips.withColumn("offset_sec", scalars.half_even(F.col("offset_sec"), 2)).withColumn("status", F.lit("ok"))
    df = df.withColumn("_vc", to_frames(F.lit(crop_sec), v_fps)).withColumn("_ac", to_frames(F.lit(crop_sec), a_fps))
    df = df.withColumn("v_start_i", to_frames(F.col("v_start_i_sec"), v_fps))
    df = df.withColumn("a_start_i", to_frames(F.col("v_start_i_sec") + F.col("offset_sec"), a_fps))
    return _check_ends(_repair_audio_start(df))


def crop_start(length: Column, crop: Column, random: Column, seed: str, key: Column) -> Column:
    """Left edge of a random or centred crop; null where the clip is shorter than the crop."""
    room = length - crop
    drawn = scalars.uniform_int(seed, F.lit(0).cast("bigint"), room, key)
    centred = scalars.half_even(room / 2).cast("bigint")
    return F.when(room == 0, F.lit(0)).when(room < 0, F.lit(None)).when(random, drawn).otherwise(centred).cast("bigint")


def syncability_crop_sec(segment_frames: int, n_segments: int, step: float, fps: float) -> float:
    return round((n_segments - (1 - step) * (n_segments - 1)) * (segment_frames / fps), 2)


def syncability_plan(
    clips: DataFrame, key: str, seed: str, grid: list[float], segment_frames: int, n_segments: int, step: float,
    fps: float, jitter_sec: float = 0.0,
) -> DataFrame:
    """Half of the clips get a grid offset, the rest an offset of a whole crop; ``sync_target`` tells which."""
    crop_sec = syncability_crop_sec(segment_frames, n_segments, step, fps)
    syncable = scalars.uniform(f"{seed}:sync", F.col(key)) < SYNCABLE_SHARE
    u = scalars.uniform(f"{seed}:offset", F.col(key))
    points = F.array(*[F.lit(float(g)) for g in grid])
    near = F.get(points, F.least(F.lit(len(grid) - 1), F.floor(u * len(grid))).cast("int"))
    far = F.when(u < 0.5, F.lit(-crop_sec)).otherwise(F.lit(crop_sec))
    planned = clips.withColumn("sync_target", syncable.cast("bigint")).withColumn(
        "offset_sec", scalars.half_even(F.when(syncable, near).otherwise(far), 2))
    return _with_target(_place_crop(planned, seed, key, crop_sec, jitter_sec), grid)


def segment_ranges(
    clips: DataFrame, size: int, step: float, n_segments: int | None = None, random_start: bool = False,
    jitter_sec: float = 0.0, seed: str = "", key: str = "clip_id",
) -> DataFrame:
    """One row per segment with its video and audio frame range; clips without room keep one status row."""
    v_fps, a_fps = F.col("v_fps"), F.col("a_fps")
    stride_v = int(step * size)
    df = clips.withColumn("_size_a", to_frames(F.lit(size) / v_fps, a_fps))
    df = df.withColumn("_stride_a", scalars.truncate(F.col("_size_a") * step))
    most_v = floor_div(F.col("v_len") - size, stride_v) + 1
    most_a = floor_div(F.col("a_len") - F.col("_size_a"), F.col("_stride_a")) + 1
    df = df.withColumn("_most", F.least(most_v, most_a))
    df = df.withColumn("_n", F.col("_most") if n_segments is None else F.lit(n_segments).cast("bigint"))
    units = F.col("_n") * step + (1 - step)
    df = df.withColumn("_span_v", scalars.truncate(units * size)).withColumn(
        "_span_a", scalars.truncate(units * F.col("_size_a")))
    room = F.col("v_len") - F.col("_span_v")
    start_v = scalars.uniform_int(f"{seed}:seg", F.lit(0).cast("bigint"), room, F.col(key)) if random_start else floor_div(room, 2)
    df = df.withColumn("_v0", start_v).withColumn("_a0", to_frames(F.col("_v0") / v_fps, a_fps))
    if jitter_sec > 0:
        most = F.least(to_frames(F.lit(jitter_sec), a_fps), F.col("_a0"), F.col("a_len") - F.col("_a0") - F.col("_span_a"))
        df = df.withColumn("_a0", F.col("_a0") + scalars.uniform_int(f"{seed}:segjit", -most, most, F.col(key)))
    status = F.when((F.col("_n") < 1) | (F.col("_n") > F.col("_most")), "too few frames for the segments")
    last_a = F.col("_a0") + (F.col("_n") - 1) * F.col("_stride_a") + F.col("_size_a")
    last_v = F.col("_v0") + (F.col("_n") - 1) * stride_v + size
    status = status.when((F.col("_a0") < 0) | (last_a > F.col("a_len")), "audio range out of bounds").when(
        last_v > F.col("v_len"), "video range out of bounds").otherwise("ok")
    df = df.withColumn("status", status)
    segments = F.when(F.col("status") == "ok", F.transform(index_range(F.col("_n")), lambda i: F.struct(
        i.alias("seg"),
        (F.col("_v0") + i * stride_v).alias("v_start"), (F.col("_v0") + i * stride_v + size).alias("v_end"),
        (F.col("_a0") + i * F.col("_stride_a")).alias("a_start"),
        (F.col("_a0") + i * F.col("_stride_a") + F.col("_size_a")).alias("a_end"))))
    return df.select(key, "status", F.inline_outer(segments))


def segment_window(size: Column, n: Column, step: Column, fps: int) -> dict[str, Column]:
    """Frames that the segments need and the shortest safe chunk, one spare frame included, in whole ms."""
    stride = scalars.truncate(step * size)
    required = size + (n - 1) * stride
    return {"required_frames": required, "safe_seconds": F.ceil((required + 1) / fps * 1000) / 1000}


def chunk_is_safe(chunk_sec: Column, safe_sec: Column) -> Column:
    """Whether a chosen chunk length holds the segments."""
    return chunk_sec + 1e-9 >= safe_sec


def chunk_starts(duration: Column, chunk: Column, stride: Column) -> Column:
    """Chunk starts that cover the whole clip, the tail included, rounded to ms, each once, in order."""
    last = duration - chunk
    regular = F.transform(index_range(F.ceil((last + 1e-6) / stride)), lambda i: i * stride)
    tail = F.when(F.abs(F.element_at(regular, -1) - last) > 1e-3, F.array(last)).otherwise(F.array().cast("array<double>"))
    covered = F.array_sort(F.array_distinct(F.transform(F.concat(regular, tail), lambda s: scalars.half_even(s, 3))))
    return F.when(duration <= chunk, F.array(F.lit(0.0))).otherwise(covered)


def window_starts(duration: Column, segment: Column, stride: Column) -> Column:
    """Sliding starts whose window fits, or one start at zero; the tail is not covered."""
    count = F.floor((duration - segment + 1e-6) / stride) + 1
    return F.transform(index_range(F.greatest(F.lit(1).cast("bigint"), count.cast("bigint"))), lambda i: i * stride)


def sample_chunk_starts(samples: Column, chunk: Column, hop: Column) -> Column:
    """Chunk starts in samples; the last start goes when the chunk before it already reaches the end."""
    count = F.ceil(F.greatest(samples, F.lit(1)) / hop).cast("bigint")
    spare = (count > 1) & ((count - 2) * hop + chunk >= samples)
    return F.transform(index_range(F.when(spare, count - 1).otherwise(count)), lambda i: i * hop)


def resample_indices(frames: Column, old_fps: Column, new_fps: Column) -> Column:
    """Source frame of every frame at the new rate."""
    step = old_fps / new_fps
    kept = F.transform(index_range(F.ceil((frames - 1e-9) / step)), lambda i: scalars.truncate(i * step))
    return F.when(old_fps == new_fps, index_range(frames)).otherwise(kept)


def token_frame(token: Column, tokens: Column, frames: Column) -> Column:
    """Frame that stands for a token in time."""
    nearest = scalars.half_even((token + 0.5) * frames / tokens - 0.5).cast("bigint")
    return scalars.clamp(nearest, F.lit(0).cast("bigint"), frames - 1)


def token_centers(clips: DataFrame, key: str, samples: str, rate: int, chunk_sec: float, hop_sec: float, per_chunk: int) -> DataFrame:
    """Centre second of each of ``per_chunk`` tokens of every chunk, the last chunk possibly shorter."""
    chunk, hop = max(1, round(chunk_sec * rate)), max(1, round(hop_sec * rate))
    if hop > chunk:
        raise ValueError("chunk hop must not exceed the chunk")
    starts = clips.select(key, samples, F.explode(sample_chunk_starts(F.col(samples), F.lit(chunk), F.lit(hop))).alias("start"))
    length = (F.least(F.col(samples), F.col("start") + chunk) - F.col("start")) / F.lit(float(rate))
    token_rate = F.lit(per_chunk) / F.greatest(length, F.lit(1e-9))
    spread = starts.where(F.col(samples) > F.col("start")).withColumn(
        "token", F.explode(F.sequence(F.lit(0), F.lit(per_chunk - 1))))
    return spread.select(key, "start", "token", (F.col("start") / float(rate) + (F.col("token") + 0.5) / token_rate).alias("center"))


def patch_grid(
    clips: DataFrame, key: str, frames: str, bins: int, patch: int, freq_stride: int, time_stride: int,
    window: int, hop: int | None = None,
) -> DataFrame:
    """Time-frequency patches of every window, without those that lie wholly in padding."""
    hop = hop or window
    n_f, n_t = (bins - patch) // freq_stride + 1, (window - patch) // time_stride + 1
    total = F.col(frames)
    windows = clips.select(key, frames, F.explode(F.transform(
        index_range(F.ceil(F.greatest(total, F.lit(1)) / hop)), lambda i: i * hop)).alias("window_start"))
    cells = windows.withColumn("fi", F.explode(F.sequence(F.lit(0), F.lit(n_f - 1)))).withColumn(
        "ti", F.explode(F.sequence(F.lit(0), F.lit(n_t - 1))))
    t0 = F.col("window_start") + F.col("ti") * time_stride
    return cells.where(t0 < total).select(
        key, "window_start", (F.col("fi") * freq_stride).cast("bigint").alias("f0"),
        F.least(F.col("fi") * freq_stride + patch, F.lit(bins)).cast("bigint").alias("f1"),
        t0.alias("t0"), F.least(t0 + patch, total).alias("t1"))
