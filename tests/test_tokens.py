import numpy as np
import pytest
from pyspark.sql import functions as F

from clipalign.operators import clustering as cl, tokens as tk


def test_raster_averages_and_marks_gaps(spark):
    df = spark.createDataFrame([("v", 0.0, 2.0, 1.0), ("v", 1.5, 1.6, 0.0), ("v", 9.0, 9.0, 1.0)], "video string, start_sec double, end_sec double, r double")
    rows = {r["bin"]: (r["r"], r["coverage"]) for r in tk.time_band_raster(df, "video", 1.0, 4, ["r"]).collect()}
    assert rows == {0: (1.0, 1), 1: (0.5, 1), 2: (0.0, 0), 3: (0.0, 0)}


def test_patch_raster_leaves_out_unassigned(spark):
    df = spark.createDataFrame([("v", 0, 2, 0, 1, 1.0, 3), ("v", 1, 2, 0, 2, 0.0, 4), ("v", 0, 9, 0, 9, 1.0, -1)],
                               "video string, f0 int, f1 int, t0 int, t1 int, r double, cluster int")
    rows = {(r["f"], r["t"]): r["r"] for r in tk.patch_raster(df, "video", ["r"]).collect()}
    assert rows == {(0, 0): 1.0, (1, 0): 0.5, (1, 1): 0.0}


def test_one_token_spans_the_clip(spark):
    df = spark.createDataFrame([(1, "v", 3.0)], "token_id long, video string, center double")
    row = tk.token_intervals(df, "video", "center", "token_id", F.lit(10.0)).head()
    assert (row["start_sec"], row["end_sec"]) == (0.0, 10.0)


def test_output_stems(spark):
    paths = ["/r/a/clip0.mp4", "/r/a/clip1.mp4", "/r/b/clip0.mp4", "/x/a/clip1.mp4", "/x/a/only.mp4", "/y/a/clip1.mov"]
    got = {r["path"]: r["output_stem"] for r in tk.output_stems(spark.createDataFrame([(p,) for p in paths], "path string"), "path").collect()}
    assert got == {"/r/a/clip0.mp4": "a_clip0", "/r/a/clip1.mp4": "a_clip1", "/r/b/clip0.mp4": "b_clip0", "/x/a/clip1.mp4": "a_clip1_0003",
                   "/x/a/only.mp4": "only", "/y/a/clip1.mov": "a_clip1_0005"}


def test_many_files_of_one_name_get_stems_of_their_own(spark):
    files = spark.range(12_000).select(F.format_string("/r/%05d/same/clip.mp4", "id").alias("path"))
    stems = tk.output_stems(files, "path")
    assert stems.select("output_stem").distinct().count() == 12_000
    last = stems.where("path = '/r/11999/same/clip.mp4'").head()
    assert last["output_stem"] == "same_clip_11999"


def test_member_lists_come_in_parts(spark):
    df = spark.range(1000).select(F.col("id").alias("token_id"), (F.col("id") % 2 - (F.col("id") % 10 == 0).cast("int")).alias("cluster"))
    rows = tk.cluster_members(df, "token_id", 64).collect()
    assert max(len(r["members"]) for r in rows) == 64
    whole = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        whole.setdefault(r["cluster"], []).extend(r["members"])
    assert whole == {0: [i for i in range(1000) if i % 2 == 0 and i % 10], 1: [i for i in range(1000) if i % 2 == 1]}


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    centers = np.eye(4) * 5
    rows = [(i, "hot" if i % 3 else "cold", i % 4, [float(x) for x in centers[i % 4] + rng.normal(scale=0.2, size=4)]) for i in range(300)]
    return spark.createDataFrame(rows, "id long, grp string, parent long, feat array<double>")


def _pure(rows, group=None):
    labels = {}
    for r in rows:
        labels.setdefault((group and r[group], r["cluster"]), set()).add(r["parent"])
    return all(len(v) == 1 for v in labels.values())


@pytest.mark.parametrize("method", ["kmeans", "spectral"])
def test_clusters_find_separate_blobs(blobs, method):
    rows = cl.token_clusters(blobs, "feat", "id", 4, 7, method=method, n_eig=4, landmarks=60).collect()
    assert len(rows) == 300 and len({r["cluster"] for r in rows}) == 4 and _pure(rows)


def test_grouped_clusters_are_lloyd_steps(blobs):
    rows = cl.grouped_clusters(blobs, "grp", "feat", "id", 3, "7", iterations=4).collect()
    assert len(rows) == 300 and all(0 <= r["cluster"] < 3 for r in rows)
    for name in ("hot", "cold"):
        mine = [r for r in rows if r["grp"] == name]
        x = np.array([r["feat"] for r in mine])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        label = np.array([r["cluster"] for r in mine])
        means = np.stack([x[label == c].mean(axis=0) for c in sorted(set(label))])
        nearest = np.array(sorted(set(label)))[((x[:, None] - means) ** 2).sum(-1).argmin(1)]
        assert (nearest == label).mean() > 0.95


def test_recursive_clusters_mark_the_rest(blobs):
    rows = cl.recursive_clusters(blobs, [0, 2], "feat", "id", 2, 7).collect()
    assert len(rows) == 300
    assert all((r["cluster"] == -1) == (r["parent"] in (1, 3)) for r in rows)


def test_colors_are_bright(blobs):
    rows = cl.cluster_colors(blobs, "parent", "feat").collect()
    assert len(rows) == 4
    assert all(0.15 <= r[c] <= 1.0 + 1e-9 for r in rows for c in "rgb") and all(len(r["hex"]) == 7 for r in rows)


def test_one_cluster_and_empty_clusters_have_a_color(blobs):
    one = cl.cluster_colors(blobs.where("parent = 1"), "parent", "feat").collect()
    assert len(one) == 1 and all(0.15 <= one[0][c] <= 1.0 for c in "rgb")
    rows = {r["parent"]: r["hex"] for r in cl.cluster_colors(blobs, "parent", "feat", n_clusters=6).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5] and rows[4] == rows[5]


def test_landmarks_may_outnumber_the_tokens(blobs):
    assert cl.landmark_embedding(blobs, "feat", "id", 4, "1", landmarks=5000).count() == 300


def test_embedding_has_unit_length(blobs):
    rows = cl.standardize_pca_l2(blobs, "feat", 2).collect()
    assert all(len(r["embedded"]) == 2 and np.linalg.norm(r["embedded"]) == pytest.approx(1.0) for r in rows)


@pytest.fixture(scope="module")
def layered(spark):
    """Five windows of three layers in each of twelve clips; window w of a clip lies near the corner w % 4, turned by the layer."""
    rng = np.random.default_rng(9)
    corners = np.eye(4) * 5
    rows = [(f"c{c:02d}", w, name, c * 100 + w * 10 + i, w % 4, [float(x) for x in np.roll(corners[w % 4], i) + rng.normal(scale=0.1, size=4)])
            for c in range(12) for w in range(5) for i, name in enumerate(("a", "b", "c"))]
    return spark.createDataFrame(rows, "clip string, win long, layer string, id long, parent long, feat array<double>")


def test_joint_layers_are_one_fit(layered):
    rows = cl.joint_layer_clusters(layered, ["b", "a", "b"], "feat", "id", 4, 7).collect()
    assert sorted((r["id"], r["place"]) for r in rows) == sorted((r["id"], p) for r in layered.collect() for p in {"b": (0, 2), "a": (1,)}.get(r["layer"], ()))
    # a token of a layer that is given twice has one cluster, and tokens of both layers share the clusters of their corners
    label = {}
    for r in rows:
        label.setdefault(r["id"], set()).add(r["cluster"])
        label.setdefault(tuple(np.round(np.array(r["feat"]) / 5).tolist()), set()).add(r["cluster"])
    assert all(len(v) == 1 for v in label.values()) and {r["cluster"] for r in rows} == {0, 1, 2, 3}


def test_concatenated_layers_share_a_cluster_by_window(layered):
    rows = cl.concat_layer_clusters(layered, ["a", "c"], "clip", "win", "feat", 4, 7).collect()
    assert sorted(r["id"] for r in rows) == sorted(r["id"] for r in layered.collect() if r["layer"] != "b")
    assert _pure(rows) and len({(r["parent"], r["cluster"]) for r in rows}) == 4
    one = {r["id"]: r["cluster"] for r in cl.concat_layer_clusters(layered, ["a"], "clip", "win", "feat", 4, 7).collect()}
    twice = {r["id"]: r["cluster"] for r in cl.concat_layer_clusters(layered, ["a", "a"], "clip", "win", "feat", 4, 7).collect()}
    assert len({(one[i], twice[i]) for i in one}) == 4
    wide = cl.concat_layer_features(layered, "clip", "win", ["c", "a"], "feat").where("clip = 'c03' and win = 2").head()["feat"]
    assert wide == [x for i in (322, 320) for r in layered.where(F.col("id") == i).collect() for x in r["feat"]]


def test_windows_that_a_layer_lacks_are_refused(layered):
    with pytest.raises(Exception, match="no token in window 3 of c05"):
        cl.concat_layer_features(layered.where("id <> 531"), "clip", "win", ["a", "b"], "feat").collect()


def test_offsets_of_layers(layered):
    some = layered.where("clip <> 'c01' or win < 2")
    joint = {(r["clip"], r["place"]): (r["layer"], r["start"], r["stop"]) for r in cl.layer_offsets(some, "clip", ["c", "a", "c"]).collect()}
    assert joint["c00", 0] == ("c", 0, 5) and joint["c00", 2] == ("c", 10, 15) and joint["c01", 1] == ("a", 17, 19) and joint["c02", 0] == ("c", 21, 26)
    shared = {(r["clip"], r["layer"]): (r["start"], r["stop"]) for r in cl.layer_offsets(some, "clip", ["c", "a"], shared=True).collect()}
    assert shared["c01", "a"] == shared["c01", "c"] == (5, 7) and shared["c02", "a"] == (7, 12) and len(shared) == 24
