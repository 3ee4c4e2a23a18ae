import numpy as np
import pytest
from pyspark.sql import functions as F

from clipalign.operators import losses, similarity as sim

S, D = 7, 6


@pytest.fixture(scope="module")
def clip(spark):
    rng = np.random.default_rng(0)
    v, a = rng.normal(size=(2, 3, S, D))
    v /= np.linalg.norm(v, axis=-1, keepdims=True)
    a /= np.linalg.norm(a, axis=-1, keepdims=True)
    rows = [(c, s, m, c * S + s, [float(x) for x in t[c, s]])
            for m, t in (("v", v), ("a", a)) for c in range(3) for s in range(S)]
    return v, a, spark.createDataFrame(rows, "video long, seg long, modality string, pair long, feat array<double>")


def test_alignment_scores(clip):
    v, a, df = clip
    for r in sim.alignment_scores(df, S).collect():
        m = v[r["video"]] @ a[r["video"]].T
        rival = np.where(np.eye(S, dtype=bool), -np.inf, m).max(axis=1)
        e = np.exp(m / 0.07)
        assert r["diag_margin"] == pytest.approx((m.diagonal() - rival).mean())
        assert r["diag_prob"] == pytest.approx((e.diagonal() / e.sum(axis=1)).mean())
        assert r["row_acc"] == pytest.approx((m.argmax(axis=1) == np.arange(S)).mean())
        assert r["n_segments"] == S


def test_single_segment_uses_the_diagonal(clip):
    _, _, df = clip
    r = sim.alignment_scores(df.where("video = 0 and seg = 0"), S).head()
    assert r["diag_margin"] == pytest.approx(r["diag_mean"]) and r["diag_prob"] == 1.0


def test_uneven_streams_use_the_leading_block(clip):
    _, _, df = clip
    short = df.where("not (modality = 'a' and seg >= 4)")
    assert {r["n_segments"] for r in sim.alignment_scores(short, S).collect()} == {4}


def test_long_clips_are_cut_into_chunks(clip):
    _, _, df = clip
    cells = sim.cross_modal(df, 3)
    assert cells.agg(F.max("col")).head()[0] == 2
    assert cells.groupBy("video").count().head()["count"] == 9 + 9 + 1


@pytest.mark.parametrize("width", [2, 4])
def test_shifted_windows(clip, width):
    v, a, df = clip
    for r in sim.shifted_window_retrieval(df, S, width).collect():
        n = S - width + 1
        wa = np.stack([a[r["video"], i:i + width].ravel() for i in range(n)])
        wv = np.stack([v[r["video"], i:i + width].ravel() for i in range(n)])
        product = wa @ wv.T
        by_video_window = (product.argmax(axis=0) == np.arange(n)).mean()
        by_audio_window = (product.argmax(axis=1) == np.arange(n)).mean()
        assert r["precision_a"] == pytest.approx(by_video_window)
        assert r["precision_v"] == pytest.approx(by_audio_window)


def test_contrastive_and_distillation(clip):
    v, a, df = clip
    x = v.reshape(-1, D) @ a.reshape(-1, D).T / 0.5
    def ce(m):
        return (np.log(np.exp(m).sum(axis=1)) - m.diagonal()).mean()
    assert losses.contrastive_loss(df, 100, 2.0).head()["loss"] == pytest.approx((ce(x) + ce(x.T)) / 2)
    same = losses.distillation_loss(df.withColumn("teacher", F.col("feat")), 100, 2.0).head()["loss"]
    def entropy(m):
        p = np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
        return -(p * np.log(p)).sum(axis=1).mean()
    assert same == pytest.approx((entropy(x) + entropy(x.T)) / 2)


def test_classes_of_any_kind_and_missing_features(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 9, [float(x) for x in rng.normal(size=5)]) for i in range(60)] + [(60, 1, None)]
    df = spark.createDataFrame(rows, "id long, target long, feat array<double>")
    named = df.withColumn("target", F.concat(F.lit("c"), "target"))
    sparse = df.withColumn("target", F.col("target") * 10**12)
    whole, *others = [{r["id"]: r["logits"] for r in sim.zero_shot_logits(x, x).collect()} for x in (df, named, sparse)]
    assert whole[60] is None and len(whole) == 61 and len(whole[0]) == 9
    for other in others:
        assert other.pop(60) is None
        assert all(other[i] == pytest.approx(whole[i]) for i in other)


def test_row_minmax_of_a_flat_row(spark):
    df = spark.createDataFrame([(0, 0.5), (0, 0.5), (1, 0.0), (1, 2.0)], "row int, sim double")
    assert sorted(r["scaled"] for r in sim.row_minmax(df, ["row"]).collect()) == [0.0, 0.0, 0.0, 1.0]


@pytest.mark.parametrize("block_rows", [7, 30, 10_000])
def test_nearest_segments_over_all_clips(spark, block_rows):
    rng = np.random.default_rng(3)
    feats = rng.normal(size=(90, 5))
    feats[40:60] = feats[0]  # equal ones: the smaller key comes first
    rows = [(int(i), "va"[i % 2], [float(x) for x in f]) for i, f in enumerate(feats)] + [(200, "v", None)]
    segments = spark.createDataFrame(rows, "segment long, modality string, feat array<double>")
    found = sim.nearest_segments(segments, F.col("segment") % 10 == 0, 4, block_rows=block_rows).collect()
    unit = feats / np.linalg.norm(feats, axis=1, keepdims=True)
    expected = {}
    for q in range(0, 90, 10):
        for kind in "va":
            sims = [(-round(float(unit[q] @ unit[p]), 9), p) for p in range(90) if p != q and "va"[p % 2] == kind]
            for rank, (s, p) in enumerate(sorted(sims)[:4], 1):
                expected[q, f"{'va'[q % 2]}2{kind}", rank] = (p, -s)
    assert {(r["segment"], r["kind"], r["rank"]): (r["partner"], r["sim"]) for r in found} == expected


def test_nearest_segments_of_few_and_no_rows(spark):
    schema = "segment long, modality string, feat array<double>"
    assert sim.nearest_segments(spark.createDataFrame([], schema), F.col("segment") >= 0, 3).count() == 0
    one = spark.createDataFrame([(1, "v", [1.0, 0.0]), (2, "a", [1.0, 1.0])], schema)
    assert [(r["segment"], r["kind"], r["partner"]) for r in sim.nearest_segments(one, F.col("segment") == 1, 3).collect()] == [(1, "v2a", 2)]
    assert sim.nearest_segments(one, F.lit(False), 3).count() == 0


def test_partners_are_cut_before_they_are_shuffled(clip):
    plan = sim.nearest_segments(clip[2].withColumn("segment", F.col("pair")), F.lit(True), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
