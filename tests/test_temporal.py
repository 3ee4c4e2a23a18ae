import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipalign.operators import evaluation as ev
from clipalign.plans import temporal as tp

GRID = ev.offset_grid(-2.0, 2.0, 21)


def _clips(spark, lengths):
    rows = [(i, v, a, 25, 16000) for i, (v, a) in enumerate(lengths)]
    return spark.createDataFrame(rows, "clip_id long, v_len long, a_len long, v_fps long, a_fps long")


def _value(spark, column):
    return spark.range(1).select(column).head()[0]


@pytest.mark.parametrize("kind", ["grid", "uniform", "uniform_binary"])
def test_offset_plans_stay_inside_the_clip(spark, kind):
    clips = _clips(spark, [(150 + i, (150 + i) * 640) for i in range(400)])
    rows = tp.offset_plan(clips, "clip_id", "s", kind, 2.0, 5.0, grid=GRID, jitter_sec=0.1).collect()
    good = [r for r in rows if r["status"] == "ok"]
    assert len(good) > 300
    for r in good:
        assert 0 <= r["v_start_i"] and r["v_end_i"] - r["v_start_i"] == 125 and r["v_end_i"] <= r["v_len"]
        assert 0 <= r["a_start_i"] and r["a_end_i"] - r["a_start_i"] == 80000 and r["a_end_i"] <= r["a_len"]
        # the jitter is at most 0.1 s, a repaired start moves by at most one video frame
        assert abs((r["a_start_i"] / 16000 - r["v_start_i_sec"]) - r["offset_sec"]) <= 0.1 + 0.04 + 1e-9
        if kind == "grid":
            assert GRID[r["offset_target"]] == pytest.approx(r["offset_sec"])
    if kind == "uniform_binary":
        low, high = tp.IN_SYNC_RANGE
        assert all((low - 0.005 <= r["offset_sec"] <= high + 0.005) == (r["oos"] == 0) or abs(r["offset_sec"]) > 0.03 for r in rows)
        assert 0.4 < np.mean([r["oos"] for r in rows]) < 0.6
        outside = [r["offset_sec"] for r in rows if r["oos"] == 1]
        assert not any(low + 0.005 < x < high - 0.005 for x in outside)


def test_clip_as_long_as_the_crop_is_reported(spark):
    rows = tp.offset_plan(_clips(spark, [(125, 80000), (124, 79360)]), "clip_id", "s", "grid", 2.0, 5.0, grid=GRID).collect()
    assert {r["status"] for r in rows} == {"clip not longer than crop"}
    assert all(r["v_start_i"] is None for r in rows)


def test_slightly_early_audio_moves_to_zero(spark):
    clips = _clips(spark, [(250, 160000)] * 3).withColumn(
        "v_start_i_sec", F.lit(1.48)).withColumn("offset_sec", F.element_at(F.array(F.lit(-1.5), F.lit(-1.6), F.lit(-1.0)), (F.col("clip_id") + 1).cast("int")))
    rows = {r["clip_id"]: r for r in tp.crop_bounds(clips, 5.0).collect()}
    assert rows[0]["status"] == "ok" and rows[0]["a_start_i"] == 0
    assert rows[1]["status"] == "audio starts before the clip"
    assert rows[2]["a_start_i"] == 7680


def test_syncability_offsets(spark):
    assert tp.syncability_crop_sec(16, 14, 0.5, 25) == 4.8
    clips = _clips(spark, [(400, 256000)] * 300)
    rows = tp.syncability_plan(clips, "clip_id", "s", GRID, 16, 14, 0.5, 25.0).collect()
    assert {abs(r["offset_sec"]) for r in rows if r["sync_target"] == 0} == {4.8}
    assert all(abs(r["offset_sec"]) <= 2.0 for r in rows if r["sync_target"] == 1)
    assert 0.4 < np.mean([r["sync_target"] for r in rows]) < 0.6


@pytest.mark.parametrize("random_start", [False, True])
def test_segments_fit_and_step(spark, random_start):
    clips = _clips(spark, [(120, 76800), (119, 76160), (500, 320000), (500, 76800)])
    rows = tp.segment_ranges(clips, 16, 0.5, 14, random_start=random_start, jitter_sec=0.2, seed="x").collect()
    by_clip = {}
    for r in rows:
        by_clip.setdefault(r["clip_id"], []).append(r)
    assert [r["status"] for r in by_clip[1]] == ["too few frames for the segments"]
    for clip in (0, 2):
        segments = sorted(by_clip[clip], key=lambda r: r["seg"])
        assert len(segments) == 14
        assert {b["v_start"] - a["v_start"] for a, b in zip(segments, segments[1:])} == {8}
        assert {b["a_start"] - a["a_start"] for a, b in zip(segments, segments[1:])} == {5120}
        assert segments[0]["v_start"] >= 0 and segments[0]["a_start"] >= 0
    if not random_start:
        assert min(r["v_start"] for r in by_clip[2]) == 190


@pytest.mark.parametrize("duration, starts", [
    (3.0, [0]), (9.0, [0]), (9.0005, [0]), (16.0, [0, 3.5, 7]), (16.0005, [0, 3.5, 7]), (20.25, [0, 3.5, 7, 10.5, 11.25])])
def test_chunk_starts_cover_the_tail(spark, duration, starts):
    assert _value(spark, tp.chunk_starts(F.lit(duration), F.lit(9.0), F.lit(3.5))) == pytest.approx(starts)


def test_chunks_of_a_long_clip_leave_no_gap(spark):
    got = _value(spark, tp.chunk_starts(F.lit(101.2), F.lit(9.0), F.lit(3.5)))
    assert got[0] == 0 and got[-1] == pytest.approx(92.2) and len(set(got)) == len(got)
    assert all(0 < y - x <= 3.5 + 1e-9 for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("duration, starts", [
    (0.5, [0.0]), (2.0, [0.0]), (2.7499, [0.0]), (2.7499999, [0.0, 0.75]), (2.75, [0.0, 0.75]), (5.0, [0.0, 0.75, 1.5, 2.25, 3.0]), (5.7, [0.0, 0.75, 1.5, 2.25, 3.0])])
def test_window_starts_leave_the_tail(spark, duration, starts):
    assert _value(spark, tp.window_starts(F.lit(duration), F.lit(2.0), F.lit(0.75))) == pytest.approx(starts)


@pytest.mark.parametrize("samples, starts", [
    (0, [0]), (1, [0]), (40, [0]), (80, [0]), (81, [0, 40]), (120, [0, 40]), (121, [0, 40, 80]),
    (400, [0, 40, 80, 120, 160, 200, 240, 280, 320])])
def test_sample_chunks_drop_a_spare_start(spark, samples, starts):
    assert _value(spark, tp.sample_chunk_starts(F.lit(samples), F.lit(80), F.lit(40))) == starts


@pytest.mark.parametrize("old,new", [(30, 25), (25, 30), (25, 25), (24, 10)])
def test_resample_indices(spark, old, new):
    want = [int(x) for x in np.arange(0, 100 - 1e-9, old / new)] if old != new else list(range(100))
    assert _value(spark, tp.resample_indices(F.lit(100), F.lit(float(old)), F.lit(float(new)))) == want


def test_token_frames(spark):
    got = [r[0] for r in spark.range(8).select(tp.token_frame(F.col("id"), F.lit(8), F.lit(16))).collect()]
    assert got == [0, 2, 4, 6, 8, 10, 12, 14]


def test_centred_crop_rounds_half_to_even(spark):
    got = [_value(spark, tp.crop_start(F.lit(n), F.lit(100), F.lit(False), "s", F.lit(1))) for n in (100, 99, 101, 103, 105)]
    assert got == [0, None, 0, 2, 2]


def test_extreme_class_and_segment_window(spark):
    grid = _value(spark, tp.class_grid(F.lit(-1.0), F.lit(1.0), F.lit(3), tp.trimmed_segments(F.lit(14), F.lit(0.5)) * 0.64))
    assert grid == pytest.approx([-1.0, 0.0, 1.0, 4.8])
    window = tp.segment_window(F.lit(16), F.lit(14), F.lit(1.0), 25)
    row = spark.range(1).select(*[c.alias(n) for n, c in window.items()]).head()
    assert row["required_frames"] == 224 and row["safe_seconds"] == math.ceil(225 / 25 * 1000) / 1000


def test_patches_skip_padding(spark):
    clips = _clips(spark, [(100, 0), (513, 0)])
    rows = tp.patch_grid(clips, "clip_id", "v_len", 56, 16, 16, 64, 512).collect()
    want = []
    for clip, total in ((0, 100), (1, 513)):
        for s in range(0, total, 512):
            for f in range((56 - 16) // 16 + 1):
                for t in range((512 - 16) // 64 + 1):
                    t0 = s + t * 64
                    if t0 < total:
                        want.append((clip, s, f * 16, min(f * 16 + 16, 56), t0, min(t0 + 16, total)))
    assert sorted(tuple(r) for r in rows) == sorted(want)
