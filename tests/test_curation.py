from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from clipalign.operators import curation as cu, joining as jo, sampling as sa


def test_listed_suffix_matches_only_when_normalized(spark):
    clips = spark.createDataFrame([("a",), ("b",), ("c",)], "clip_id string")
    blocked = spark.createDataFrame([("a.mp4",), ("b",)], "clip_id string")
    assert sorted(r[0] for r in cu.remove_blocked(clips, blocked, "clip_id").collect()) == ["a", "c"]
    assert [r[0] for r in cu.remove_blocked(clips, blocked, "clip_id", normalize=True).collect()] == ["c"]


def test_key_in_two_lists_is_counted(spark):
    one, two = (spark.createDataFrame([("a",), (x,)], "k string") for x in "bc")
    got = {r["k"]: r["n_lists"] for r in cu.blocklist_union({"one": one, "two": two}, "k").collect()}
    assert got == {"a": 2, "b": 1, "c": 1}


def test_duplicate_offset_is_an_error(spark):
    clips = spark.createDataFrame([("a",)], "k string")
    offsets = spark.createDataFrame([("a", 0.1, 1.0, 1), ("a", 0.1, 1.0, 1)], "k string, offset_sec double, v_start_i_sec double, is_sync int")
    with pytest.raises(PySparkException, match="more than one fixed offset"):
        cu.attach_fixed_offsets(clips, offsets, "k").collect()


def test_repeated_offsets_must_agree(spark):
    same = spark.createDataFrame([("a", 0.1), ("a", 0.1), ("b", 0.2)], "path string, offset_sec double")
    assert {r["path"]: r["n_rows"] for r in cu.merge_fixed_offsets(same, "path").collect()} == {"a": 2, "b": 1}
    with pytest.raises(PySparkException, match="offsets vary"):
        cu.merge_fixed_offsets(same.union(spark.createDataFrame([("b", 0.3)])), "path").collect()


def test_coverage_check_is_waived_for_few_clips(spark):
    classes = spark.createDataFrame([("x",), ("y",)], "label string")
    clips = spark.createDataFrame([("x",)], "label string")
    assert [r[0] for r in cu.uncovered_classes(clips, classes, "label").collect()] == ["y"]
    assert cu.uncovered_classes(clips, classes, "label", waive_below=1000).isEmpty()


def test_unknown_folder_gives_no_key(spark):
    row = spark.range(1).select(cu.expand_folder(F.lit("eval/x")).alias("a")).head()
    assert row["a"] == "eval_segments/x"


def test_resolve_duration_ignores_bad_candidates(spark):
    cols = cu.resolve_duration([F.lit(None), F.lit(float("nan")), F.lit(-3.0), F.lit(0.0)])
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).head()
    assert row["duration_sec"] is None and row["disagrees"] is False


@pytest.fixture(scope="module")
def videos(spark):
    """One class and one parent hold a third of all videos."""
    rows = [(f"v{i:05d}", "hot" if i % 3 == 0 else f"c{i % 7}", "test" if i % 5 == 0 else "train") for i in range(1500)]
    return rows, spark.createDataFrame(rows, "video_id string, label string, split string")


def test_stratified_split_matches_test_counts(spark, videos):
    rows, df = videos
    clips = df.select(F.concat("video_id", F.lit("_0")).alias("clip_id"), "video_id")
    stray = spark.createDataFrame([("zz_0", "zz")], "clip_id string, video_id string")
    got = sa.stratified_valid_split(df, clips.union(stray), "1").collect()
    label = {v: l for v, l, _ in rows}
    split = {r["video_id"]: r["split"] for r in got}
    assert len(got) == len(split) == len(rows)
    assert Counter(label[v] for v, s in split.items() if s == "valid") == Counter(l for _, l, s in rows if s == "test")
    assert all(split[v] == "test" for v, _, s in rows if s == "test")


def test_group_split_keeps_groups_whole(videos):
    _, df = videos
    clips = df.drop("split").withColumn("parent", F.when(F.col("label") == "hot", "p").otherwise(F.substring("video_id", 3, 3)))
    got = sa.group_split(clips, "parent", "1").select("parent", "split").distinct().collect()
    counts = Counter(r["split"] for r in got)
    n = len(got)
    assert n == clips.select("parent").distinct().count()
    assert counts["test"] == counts["valid"] == int(n * 0.1)


def test_subsample_keeps_at_least_one(videos):
    _, df = videos
    assert sa.subsample(df, "video_id", 1e-6, "1").count() == 1
    assert sa.subsample(df, "video_id", 1e-6, "1", at_least=0).count() == 0
    assert sa.subsample(df, "video_id", 0.25, "1").count() == 375
    assert sa.subsample(df, "video_id", None, "1").count() == 1500


@pytest.mark.parametrize("size", [3, 40, 5000])
def test_cluster_sample_has_the_exact_size(videos, size):
    rows, df = videos
    got = sa.cluster_stratified_sample(df, "video_id", "label", size, "1").collect()
    assert len({r["video_id"] for r in got}) == len(got) == min(size, len(rows))
    if size == 40:
        assert {r["label"] for r in got} == {l for _, l, _ in rows}


def test_weighted_draws_follow_the_weights(spark):
    shards = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 3.5), ("d", 0.5)], "shard string, w double")
    draws = spark.range(20000).withColumnRenamed("id", "draw")
    got = {r["shard"]: r["count"] for r in sa.weighted_draws(draws, "draw", shards, "shard", "w", "1").groupBy("shard").count().collect()}
    assert sum(got.values()) == 20000 and "b" not in got
    assert got["c"] / 20000 == pytest.approx(0.7, abs=0.02)


@pytest.mark.parametrize("n, size, kept", [(10, 4, [0, 2, 5, 7]), (7, 7, [0, 1, 2, 3, 4, 5, 6]), (3, 10, [0, 1, 2]), (12, 5, [0, 2, 4, 7, 9]), (9, 2, [0, 4]), (5, 1, [0])])
def test_evenly_spaced_positions(spark, n, size, kept):
    assert sorted(r["id"] for r in sa.evenly_spaced(spark.range(n), "id", size).collect()) == kept


@pytest.mark.parametrize("low, high, n, mode, frames", [
    (0, 99, 8, "uniform", [0, 14, 28, 42, 57, 71, 85, 99]), (0, 99, 8, "first", [0, 1, 2, 3, 4, 5, 6, 7]),
    (0, 99, 8, "center", [45, 46, 47, 48, 49, 50, 51, 52]), (5, 5, 4, "uniform", [5, 5, 5, 5]), (5, 5, 4, "first", [5, 5, 5, 5]),
    (5, 5, 4, "center", [5, 5, 5, 5]), (10, 13, 8, "uniform", [10, 11, 12, 13, 13, 13, 13, 13]),
    (10, 13, 8, "center", [10, 11, 12, 13, 13, 13, 13, 13]), (3, 10, 8, "center", [3, 4, 5, 6, 7, 8, 9, 10])])
def test_frame_indices(spark, low, high, n, mode, frames):
    column = sa.frame_indices(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"), n, mode)
    assert spark.range(1).select(column).head()[0] == frames


def test_epoch_shuffle_spreads_evenly(spark):
    got = sa.epoch_shuffle(spark.range(240), "id", 1, 2, 4, 3)
    assert {r["count"] for r in got.groupBy("node", "worker").count().collect()} == {20}
    other = sa.epoch_shuffle(spark.range(240), "id", 1, 3, 4, 3)
    assert got.orderBy("id").collect() != other.orderBy("id").collect()


def test_pool_windows_against_brute_force(spark):
    rng = np.random.default_rng(2)
    tokens = [(i, "hot" if i % 3 else f"v{i % 4}", float(rng.integers(0, 240)) / 2, float(i)) for i in range(300)]
    tokens += [(1000, "lone", 7.0, 5.0)]
    spans = {"hot": 120.0, "lone": 50.0, "v0": 119.0, "v1": 4.0, "v2": 100.0, "v3": 90.5}
    df = spark.createDataFrame(tokens, "token_id long, video string, center double, value double")
    lengths = spark.createDataFrame(list(spans.items()), "video string, duration_sec double")
    got = jo.pool_windows(df, lengths, 5.0, 2.0).collect()
    seen = Counter(r["video"] for r in got)
    for video, span in spans.items():
        starts = np.arange(0.0, max(0.0, span - 5.0) + 1e-9, 2.0)
        assert seen[video] == max(1, len(starts))
    for r in got:
        mine = sorted((c, t, v) for t, name, c, v in tokens if name == r["video"])
        inside = [v for c, _, v in mine if r["start_sec"] <= c < r["end_sec"]]
        middle = (r["start_sec"] + r["end_sec"]) / 2
        want = np.mean(inside) if inside else min(mine, key=lambda m: (abs(m[0] - middle), m[0], m[1]))[2]
        if inside or len(mine):
            assert r["pooled"] == pytest.approx(want), (r, inside)


def test_nearest_index_takes_the_first_on_a_tie(spark):
    grid = F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0))
    df = spark.createDataFrame([(0.5,), (-0.5,), (9.0,)], "v double")
    assert [r[0] for r in df.select(jo.nearest_index(grid, F.col("v"))).collect()] == [1, 0, 2]


def test_run_matching_sees_order_and_parameters(spark):
    items = [(run, p, x) for run, xs in {1: "ab", 2: "ab", 3: "ba", 4: "abc", 5: "ba", 6: "zz"}.items() for p, x in enumerate(xs)]
    listed = spark.createDataFrame(items, "run long, position int, item string")
    runs = spark.createDataFrame([(r, "s", r) for r in range(1, 7)], "run long, seed string, mtime long")
    got = jo.match_parent_runs(runs.where("run in (1, 3, 6)"), runs.where("run in (2, 4, 5)"), listed, ["seed"])
    assert {r["run"]: (r["status"], r["parent_run"]) for r in got.collect()} == {1: ("matched", 2), 3: ("matched", 5), 6: ("none", None)}
    two = runs.where("run = 2").union(spark.createDataFrame([(1, "s", 9)]))
    assert jo.match_parent_runs(runs.where("run = 1"), two, listed, ["seed"]).head()["status"] == "ambiguous"


def test_frame_range(spark):
    null = F.lit(None).cast("double")
    def bounds(start, duration):
        cols = sa.frame_range(start, duration, F.lit(25.0), F.lit(100).cast("bigint"))
        return tuple(spark.range(1).select(cols["low"], cols["high"]).head())
    assert bounds(null, null) == (0, 99)
    assert bounds(F.lit(1.0), F.lit(2.0)) == (25, 74)
    assert bounds(F.lit(3.5), F.lit(9.0)) == (88, 99)


def test_unlisted_shards_leave_no_total(spark):
    shards = spark.createDataFrame([("a", "1.tar"), ("a", "2.tar"), ("b", "1.tar"), ("c", "1.tar")], "dataset string, shard string")
    sizes = spark.createDataFrame([("a", '{"1.tar": 5}'), ("b", '{"1.tar": 7}')], "dataset string, sizes_json string")
    lengths = spark.createDataFrame([("c", 9)], "dataset string, stated long")
    rows = {r["dataset"]: (r["total_size"], r["num_shards"], r["num_unlisted"]) for r in cu.dataset_sizes(shards, sizes, lengths).collect()}
    assert rows == {"a": (None, 2, 1), "b": (7, 1, 0), "c": (9, 1, 0)}


def test_no_sample_size_means_all_tokens(spark):
    tokens = spark.range(20).withColumn("cluster", F.col("id") % 3)
    assert sa.cluster_stratified_sample(tokens, "id", "cluster", 0, "s").count() == 20


@pytest.mark.parametrize("unit", [1e-12, 1.0, 1e15])
def test_weights_of_any_size_draw_alike(spark, unit):
    shards = spark.createDataFrame([("a", 1.0 * unit), ("b", 3.0 * unit)], "shard string, weight double")
    drawn = sa.weighted_draws(spark.range(400), "id", shards, "shard", "weight", "s")
    counts = {r["shard"]: r["count"] for r in drawn.groupBy("shard").count().collect()}
    assert sum(counts.values()) == 400 and 60 < counts["a"] < 140
