import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipalign.operators import evaluation as ev, ranking_metrics as rm, telemetry as tm

GRID = ev.offset_grid(-1.0, 1.0, 5)


def _trials(spark, rows):
    return spark.createDataFrame(
        [("m", i, f"/s/a-{i % 2}.tar::c{i}.mp4", t, l) for i, (t, l) in enumerate(rows)],
        "model_name string, trial long, sample_id string, target long, logits array<double>")


def test_ties_take_the_lower_class(spark):
    rows = ev.trial_rows(_trials(spark, [(1, [0.0, 5.0, 5.0, 1.0, 2.0])]), GRID)
    row = rows.head()
    assert (row["pred_class_index"], row["top2_class_index"], row["top3_class_index"]) == (1, 2, 4)
    assert rows.columns == ev.TRIAL_FIELDS


def test_bad_row_fails_its_whole_batch(spark):
    good = (0, [3.0, 1.0, 0.0, 0.0, 0.0])
    rows = ev.trial_rows(_trials(spark, [good, (0, None), good, good]), GRID, batch_size=2)
    assert [r["status"] for r in rows.orderBy("batch_idx", "sample_idx_in_batch").collect()] == ["error", "error", "ok", "ok"]
    summary = ev.trial_summary(rows, GRID).head()
    assert (summary["num_trials"], summary["num_errors"], summary["accuracy_1"]) == (2, 2, 1.0)


def test_absent_classes_count_as_zero(spark):
    hit, miss = [9.0, 0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0, 9.0]
    summary = ev.trial_summary(ev.trial_rows(_trials(spark, [(0, hit), (4, miss), (1, miss)]), GRID), GRID).head()
    assert summary["accuracy_1_median_over_all_classes_missing_as_zero"] == 0.0
    assert summary["accuracy_1_median_over_present_classes"] == 1.0


def test_all_error_batch_has_no_figures(spark):
    summary = ev.trial_summary(ev.trial_rows(_trials(spark, [(0, None)]), GRID), GRID).head()
    assert summary["num_errors"] == 1 and summary["accuracy_1"] is None


def test_median_of_very_many_distinct_errors(spark):
    errors = spark.range(100_000).select(
        F.lit("m").alias("model_name"), F.lit("ok").alias("status"), (F.col("id") % 5).alias("target_class_index"), F.lit(1).alias("top1_correct"),
        F.lit(1).alias("top1_pm1_class_correct"), F.lit(1).alias("top5_correct"), F.lit(0).cast("bigint").alias("abs_class_error"),
        (F.col("id") * 7919 % 100_003 / 1000).alias("abs_offset_error_sec"))
    summary = ev.trial_summary(errors, GRID).head()
    assert summary["num_trials"] == 100_000
    assert summary["median_abs_offset_error_sec"] == pytest.approx(np.median(np.arange(100_000) * 7919 % 100_003 / 1000))


def test_zero_class_needs_a_zero():
    assert ev.zero_class(GRID) == 2
    assert ev.zero_class(ev.offset_grid(-2, 2, 10)) is None
    with pytest.raises(ValueError):
        ev.offset_grid(-1, 1, 2)


def test_full_summary_has_every_field(spark):
    hit = [0.0, 0.0, 9.0, 0.0, 0.0]
    rows = ev.trial_rows(_trials(spark, [(2, hit), (2, hit), (1, hit)]), GRID)
    summary = ev.full_summary(rows, GRID, 1).head()
    assert list(summary.asDict()) == ev.SUMMARY_FIELDS
    assert summary["correct_target_class_count_per_tar_json"] == '{"a-0.tar":{"2":1},"a-1.tar":{"2":1}}'
    assert summary["zero_offset_num_trials"] == 2 and summary["num_clips"] == 3
    assert ev.full_summary(rows, GRID, 1, shard_maps=False).head()["correct_target_class_count_per_tar_json"] is None


def test_summary_without_a_zero_class_and_with_odd_names(spark):
    grid = ev.offset_grid(-2, 2, 4)
    rows = ev.trial_rows(_trials(spark, [(0, [9.0, 0.0, 0.0, 0.0]), (1, [9.0, 0.0, 0.0, 0.0])]), grid)
    rows = rows.withColumn("sample_id", F.lit('a "quoted".tar::x'))
    summary = ev.full_summary(rows, grid, 1).head()
    assert summary["zero_offset_target_class_index"] is None and summary["zero_offset_num_trials"] == 0
    assert json.loads(summary["zero_offset_pred_class_count_json"]) == {"0": 0, "1": 0, "2": 0, "3": 0}
    assert json.loads(summary["correct_target_class_count_per_tar_json"]) == {'a "quoted".tar': {"0": 1}}


def test_a_class_with_several_offsets_in_a_shard(spark):
    rows = spark.createDataFrame(
        [("m", "s.tar::a", 1, 0, 0.1), ("m", "s.tar::b", 1, 0, 0.2), ("m", "s.tar::c", 1, 3, 0.1), ("m", "s.tar::d", 0, 3, 0.1)],
        "model_name string, sample_id string, top1_correct int, target_class_index long, target_offset_sec double")
    row = ev.shard_rollup(rows).head()
    assert row["class_count_json"] == '{"0":2,"3":1}' and row["offset_count_json"] == '{"0.1":2,"0.2":1}' and row["n_correct"] == 3


def test_tiers_take_thresholds_in_any_order(spark):
    df = spark.createDataFrame([(0, [9.0, 0.0], 0.8, 1), (1, [0.0, 9.0], 0.96, 1)], "target long, logits array<double>, sync_prob double, sync_target long")
    assert {r["threshold"]: r["n"] for r in ev.confidence_tiers(df, 2, [0.95, 0.5]).collect()} == {0.5: 2, 0.95: 1}


def _areas(score, positive):
    pos, neg = score[positive], score[~positive]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    thresholds = np.unique(score)[::-1]
    recall, ap = 0.0, 0.0
    for t in thresholds:
        taken = score >= t
        tp = (taken & positive).sum()
        ap += (tp / positive.sum() - recall) * tp / taken.sum()
        recall = tp / positive.sum()
    return ap, auc


def test_area_metrics_with_ties(spark):
    rng = np.random.default_rng(5)
    score, positive = rng.integers(0, 12, 400) / 12, rng.random(400) < 0.3
    df = spark.createDataFrame([(0, float(s), bool(p)) for s, p in zip(score, positive)], "g int, score double, positive boolean")
    row = rm.area_metrics(df, ["g"]).head()
    ap, auc = _areas(score, positive)
    assert row["average_precision"] == pytest.approx(ap) and row["roc_auc"] == pytest.approx(auc)


def test_one_outcome_gives_no_area(spark):
    df = spark.createDataFrame([(0, 0.5, True)], "g int, score double, positive boolean")
    assert rm.area_metrics(df, ["g"]).head()["roc_auc"] is None


def test_roc_curve_drops_straight_points(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 0)]
    df = spark.createDataFrame(rows, "prob double, target int")
    points = [(r["fpr"], r["tpr"]) for r in rm.roc_curve(df).orderBy(F.col("threshold").desc()).collect()]
    assert points == [(0.0, 0.0), (0.0, 1 / 3), (0.0, 1.0), (1.0, 1.0)]


def test_dprime_of_chance_is_zero(spark):
    df = spark.createDataFrame([(0.5,), (0.8413447460685429,)], "mroc_auc double")
    values = [r["dprime"] for r in rm.with_dprime(df).collect()]
    assert values == pytest.approx([0.0, 2 ** 0.5], abs=1e-9)


def test_confidence_tiers_move_wrong_sync_targets(spark):
    rows = [(3, [0, 0, 0, 9.0, 0, 0, 0], 0.97, 1), (3, [0, 0, 0, 9.0, 0, 0, 0], 0.75, 0)]
    df = spark.createDataFrame([(t, [float(x) for x in l], p, s) for t, l, p, s in rows],
                               "target long, logits array<double>, sync_prob double, sync_target long")
    got = {r["threshold"]: (r["n"], r["accuracy_1"]) for r in ev.confidence_tiers(df, 7).collect()}
    assert got[0.7] == (2, 0.5) and got[0.95] == (1, 1.0) and 0.99 not in got


def test_early_stop_starts_at_zero_and_stays_triggered(spark):
    df = spark.createDataFrame([("r", i, m) for i, m in enumerate([0.0, 0.2, 0.1, 0.2, 0.5])], "run string, epoch long, metric double")
    rows = tm.early_stopping(df, 2, True).orderBy("epoch").collect()
    assert [r["no_change"] for r in rows] == [1, 0, 1, 2, 0]
    assert [r["triggered"] for r in rows] == [False, False, False, True, True]


def test_metric_lookup_and_first_epoch_rule(spark):
    maps = [{"precision": "0.1"}, {"valid/precision": "0.3"}, {"x": "1"}, {"a_precision": "bad", "b/precision": "0.2"}, {"precision": "bad", "v/precision": "1"}]
    df = spark.createDataFrame([("r", i, m) for i, m in enumerate(maps)], "run string, epoch long, metrics map<string,string>")
    found = df.select("run", "epoch", tm.metric_lookup(F.col("metrics"), "precision").alias("metric"))
    assert [r["metric"] for r in found.orderBy("epoch").collect()] == [0.1, 0.3, None, 0.2, None]
    best = [r["is_best"] for r in tm.best_epochs(found, True).orderBy("epoch").collect()]
    assert best == [True, True, False, False, False]
    late = tm.best_epochs(found.where("epoch >= 2"), True).orderBy("epoch").collect()
    assert [r["is_best"] for r in late] == [True, True, False]
