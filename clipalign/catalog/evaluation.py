"""Evaluation queries: trial tables, summaries, rollups and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign import views
from clipalign.catalog import query, tidy
from clipalign.catalog.ctes import RANKED, SYNC_SCORES, TRIALS, double_list, r6, with_ctes
from clipalign.operators import evaluation as ev, losses, ranking_metrics as rm

GRID = ev.offset_grid(-2.0, 2.0, 10)
# The even-sized grid has no zero point; this one replaces it where the zero class matters.
ZERO_GRID = [-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5]
_G = double_list(GRID)


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with a start time, where every 97th has lost its logits."""
    trials = views.trials(spark, sf_dir)
    return trials.withColumn("v_start", (F.col("trial") % 5) * F.lit(0.2)).withColumn(
        "logits", F.when(F.col("trial") % 97 != 0, F.col("logits")))


def _rows(spark: SparkSession, sf_dir: str, grid=GRID) -> DataFrame:
    return ev.trial_rows(_planned(spark, sf_dir), grid, exp_name="exp-a")


ROWS = f"""{TRIALS},{RANKED},
bad AS (SELECT DISTINCT model_name, trial // 32 AS batch_idx FROM trials WHERE trial % 97 = 0),
base AS (
  SELECT t.*, t.trial // 32 AS b, b.batch_idx IS NULL AS ok, (t.trial % 5) * 0.2::DOUBLE AS vs,
         o.top_idx, o.top_p, o.top_l
  FROM trials t JOIN tops o USING (trial)
  LEFT JOIN bad b ON b.model_name = t.model_name AND b.batch_idx = t.trial // 32
),
good AS (
  SELECT *, {_G}[target + 1] AS toff, top_idx[1] AS pred, {_G}[top_idx[1] + 1] AS poff FROM base WHERE ok
)"""

_ROW_FIGURES = {
    "target_offset_sec": "toff", "target_class_index": "target", "pred_offset_sec": "poff",
    "pred_class_index": "pred::BIGINT", "pred_probability": "top_p[1]",
    "top1_correct": "(pred = target)::BIGINT", "top1_pm1_class_correct": "(abs(pred - target) <= 1)::BIGINT",
    "top5_correct": "list_contains(top_idx, target)::BIGINT", "abs_class_error": "abs(pred - target)::BIGINT",
    "abs_offset_error_sec": "abs(poff - toff)", "v_start_i_sec": "vs", "v_end_i_sec": "vs + 5",
    "a_start_i_sec": "vs + toff", "a_end_i_sec": "vs + toff + 5", "crop_duration_sec": "5.0::DOUBLE",
    "pred_a_start_i_sec": "vs + poff", "pred_a_end_i_sec": "vs + poff + 5",
}
for _r in range(1, 6):
    _ROW_FIGURES[f"top{_r}_offset_sec"] = f"{_G}[top_idx[{_r}] + 1]"
    _ROW_FIGURES[f"top{_r}_probability"] = f"top_p[{_r}]"
    _ROW_FIGURES[f"top{_r}_class_index"] = f"top_idx[{_r}]::BIGINT"
    _ROW_FIGURES[f"top{_r}_logit"] = f"top_l[{_r}]"
_INTEGER = {n for n in _ROW_FIGURES if n.endswith(("_index", "_correct", "_class_error"))}
_ROW_SELECT = ", ".join(
    (f"{e} AS {n}" if n in _INTEGER else r6(e, n)) for n, e in _ROW_FIGURES.items())
_ROW_HEAD = """model_name, 'exp-a' AS exp_name, 0::BIGINT AS iter_idx, b AS batch_idx,
  trial % 32 AS sample_idx_in_batch, sample_id"""


@query("zero_shot_classify", with_ctes([TRIALS, RANKED], f"""
SELECT t.trial, t.target, o.top_idx[1]::BIGINT AS pred_class, {r6("o.top_l[1]", "logit")},
       (o.top_idx[1] = t.target)::BIGINT AS top1, list_contains(o.top_idx, t.target)::BIGINT AS top5
FROM trials t JOIN tops o USING (trial)"""))
def zero_shot_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ev.top_k(views.trials(spark, sf_dir), GRID)
    return tidy(ranked.select(
        "trial", "target", F.col("top1_class_index").alias("pred_class"), F.col("top1_logit").alias("logit"),
        (F.col("top1_class_index") == F.col("target")).cast("bigint").alias("top1"),
        F.array_contains("top_idx", F.col("target").cast("int")).cast("bigint").alias("top5")))


@query("topk_classes", with_ctes([TRIALS, RANKED], "SELECT trial, " + ", ".join(
    f"{r6(f'{_G}[top_idx[{r}] + 1]', f'top{r}_offset_sec')}, {r6(f'top_p[{r}]', f'top{r}_probability')}, "
    f"top_idx[{r}]::BIGINT AS top{r}_class_index, {r6(f'top_l[{r}]', f'top{r}_logit')}" for r in range(1, 6)
) + " FROM tops"))
def topk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.top_k(views.trials(spark, sf_dir), GRID).drop(
        "model_name", "sample_id", "target", "logits", "top_idx"))


@query("trial_rows", with_ctes([ROWS], f"""
SELECT {_ROW_HEAD}, 'ok' AS status, '' AS error, {_ROW_SELECT} FROM good"""))
def trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_rows(spark, sf_dir).where("status = 'ok'"))


@query("trial_error_rows", with_ctes([ROWS], f"""
SELECT {_ROW_HEAD}, 'error' AS status, 'batch has unusable logits or target' AS error,
  NULL::BIGINT AS pred_class_index, NULL::DOUBLE AS pred_probability
FROM base WHERE NOT ok"""))
def trial_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _rows(spark, sf_dir).where("status = 'error'")
    return errors.select(*ev.TRIAL_FIELDS[:8], "pred_class_index", "pred_probability")


@query("trial_summary", with_ctes([ROWS, """
n AS (SELECT model_name, count(*) FILTER (ok) AS num_trials, count(*) FILTER (NOT ok) AS num_errors
      FROM base GROUP BY 1)""", """
pc AS (SELECT model_name, target, avg((pred = target)::INT) AS acc FROM good GROUP BY 1, 2)""", """
present AS (SELECT model_name, median(acc) AS present FROM pc GROUP BY 1)""", """
every AS (SELECT m.model_name, median(coalesce(pc.acc, 0)) AS every
          FROM (SELECT DISTINCT model_name, c FROM base, range(10) g(c)) m
          LEFT JOIN pc ON pc.model_name = m.model_name AND pc.target = m.c GROUP BY 1)"""], f"""
SELECT g.model_name, n.num_trials, n.num_errors,
  {r6("avg((pred = target)::INT)", "accuracy_1")},
  {r6("avg((abs(pred - target) <= 1)::INT)", "accuracy_1_pm1_class")},
  {r6("avg(list_contains(top_idx, target)::INT)", "accuracy_5")},
  {r6("avg(abs(pred - target))", "mean_abs_class_error")},
  {r6("median(abs(pred - target))", "median_abs_class_error")},
  {r6("avg(abs(poff - toff))", "mean_abs_offset_error_sec")},
  {r6("median(abs(poff - toff))", "median_abs_offset_error_sec")},
  {r6("any_value(every)", "accuracy_1_median_over_all_classes_missing_as_zero")},
  {r6("any_value(present)", "accuracy_1_median_over_present_classes")},
  10::BIGINT AS num_classes, -2.0::DOUBLE AS grid_min_sec, 2.0::DOUBLE AS grid_max_sec,
  {r6(f"{_G}[2] - {_G}[1]", "grid_step_sec")}
FROM good g JOIN n USING (model_name) JOIN every USING (model_name) JOIN present USING (model_name)
GROUP BY g.model_name, n.num_trials, n.num_errors"""))
def trial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.trial_summary(_rows(spark, sf_dir), GRID))


@query("class_counts", with_ctes([ROWS], """
SELECT model_name, '{' || string_agg('"' || c || '":' || n, ',' ORDER BY c::VARCHAR) || '}' AS target_count_per_class_json
FROM (SELECT m.model_name, m.c, count(g.trial) AS n
      FROM (SELECT DISTINCT model_name, c FROM base, range(10) x(c)) m
      LEFT JOIN good g ON g.model_name = m.model_name AND g.target = m.c GROUP BY 1, 2) GROUP BY 1"""))
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.class_counts(_rows(spark, sf_dir), len(GRID))


@query("shard_rollup", with_ctes([ROWS, """
sc AS (SELECT model_name, 'shard-' || (trial % 8) || '.tar' AS shard, target::VARCHAR AS cls,
              format('{:.6g}', toff) AS okey, count(*) AS n
       FROM good WHERE pred = target GROUP BY 1, 2, 3, 4)"""], """
SELECT model_name, shard,
  '{' || string_agg('"' || cls || '":' || n, ',' ORDER BY cls) || '}' AS class_count_json,
  '{' || string_agg('"' || okey || '":' || n, ',' ORDER BY okey) || '}' AS offset_count_json,
  sum(n)::BIGINT AS n_correct
FROM sc GROUP BY 1, 2"""))
def shard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.shard_rollup(_rows(spark, sf_dir))


@query("json_counts", with_ctes([TRIALS, RANKED], """
SELECT shard, '{' || string_agg('"' || target || '":' || n, ',' ORDER BY target::VARCHAR) || '}' AS counts_json
FROM (SELECT 'shard-' || (trial % 8) || '.tar' AS shard, target, count(*) AS n FROM trials GROUP BY 1, 2) GROUP BY 1"""))
def json_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipalign.functions.scalars import shard_name

    counts = views.trials(spark, sf_dir).groupBy(
        shard_name(F.col("sample_id")).alias("shard"), F.col("target").cast("string").alias("key")
    ).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("key", "n")))
    return counts.groupBy("shard").agg(F.to_json(F.map_from_entries(entries)).alias("counts_json"))


@query("zero_offset_confusion", with_ctes([ROWS, """
z AS (SELECT model_name, pred, count(*) AS n FROM good WHERE target = 4 GROUP BY 1, 2)""", """
zt AS (SELECT model_name, sum(n) AS total FROM z GROUP BY 1)"""], f"""
SELECT m.model_name, m.c AS cls, {r6(f"{double_list(ZERO_GRID)}[m.c + 1]", "pred_offset_sec")},
  coalesce(z.n, 0) AS n, {r6("coalesce(z.n / nullif(zt.total, 0), 0)", "frequency")}
FROM (SELECT DISTINCT model_name, c FROM base, range(10) x(c)) m
LEFT JOIN z ON z.model_name = m.model_name AND z.pred = m.c LEFT JOIN zt ON zt.model_name = m.model_name"""))
def zero_offset_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.zero_offset_confusion(_rows(spark, sf_dir, ZERO_GRID), ZERO_GRID))


_EPS = "(count(*) + 1e-7::DOUBLE)"
_NEAR1 = "abs(top_idx[1] - target) <= 1"
_NEAR5 = "len(list_filter(top_idx, lambda c: abs(c - target) <= 1)) > 0"


@query("topk_accuracy", with_ctes([TRIALS, RANKED, SYNC_SCORES], f"""
SELECT model_name, {r6("avg((top_idx[1] = target)::INT)", "accuracy_1")},
  {r6("avg(list_contains(top_idx, target)::INT)", "accuracy_5")}
FROM trials JOIN tops USING (trial) GROUP BY 1
UNION ALL SELECT 'binary', {r6("avg(((prob > 0.5)::INT = target)::INT)", "accuracy_1")}, NULL FROM sync"""))
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = ev.topk_accuracy(views.trials(spark, sf_dir), ["model_name"])
    two = ev.binary_accuracy(views.sync_scores(spark, sf_dir)).withColumn("model_name", F.lit("binary"))
    return tidy(many.unionByName(two, allowMissingColumns=True))


@query("tolerance_accuracy", with_ctes([TRIALS, RANKED], f"""
SELECT model_name, 0 AS without_doubt, {r6(f"sum(({_NEAR1})::INT) / {_EPS}", "accuracy_1_tol1")},
  {r6(f"sum(({_NEAR5})::INT) / {_EPS}", "accuracy_5_tol1")}
FROM trials JOIN tops USING (trial) GROUP BY 1
UNION ALL
SELECT model_name, 1, {r6(f"sum(({_NEAR1})::INT) / {_EPS}")}, {r6(f"sum(({_NEAR5})::INT) / {_EPS}")}
FROM trials JOIN tops USING (trial) WHERE target <> 9 GROUP BY 1"""))
def tolerance_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = views.trials(spark, sf_dir)
    plain = ev.tolerance_accuracy(trials, ["model_name"], 10).withColumn("without_doubt", F.lit(0))
    sure = ev.tolerance_accuracy(trials, ["model_name"], 10, doubt_class=True).withColumn("without_doubt", F.lit(1))
    return tidy(plain.unionByName(sure))


@query("per_class_metrics", with_ctes([TRIALS, RANKED], f"""
SELECT m.model_name, m.c AS target, count(trial) AS n, {r6("avg((top_idx[1] = t.target)::INT)", "accuracy_1")},
  {r6("avg(list_contains(top_idx, t.target)::INT)", "accuracy_5")},
  CASE WHEN count(trial) > 0 THEN {r6("sum((abs(top_idx[1] - t.target) <= 1)::INT) / (count(trial) + 1e-7::DOUBLE)")}
    END AS accuracy_1_tol1,
  CASE WHEN count(trial) > 0 THEN {r6('''sum((len(list_filter(top_idx, lambda c: abs(c - t.target) <= 1)) > 0)::INT)
    / (count(trial) + 1e-7::DOUBLE)''')} END AS accuracy_5_tol1
FROM (SELECT DISTINCT model_name, c FROM trials, range(12) x(c)) m
LEFT JOIN (SELECT * FROM trials JOIN tops USING (trial)) t ON t.model_name = m.model_name AND t.target = m.c
GROUP BY 1, 2"""))
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two classes more than the data has, to show empty ones
    return tidy(ev.per_class_metrics(views.trials(spark, sf_dir), ["model_name"], 12))


@query("pred_target_hist", with_ctes([TRIALS, RANKED], f"""
SELECT m.model_name, m.c AS cls, (SELECT count(*) FROM tops o JOIN trials t USING (trial)
    WHERE t.model_name = m.model_name AND o.top_idx[1] = m.c) AS n_pred,
  (SELECT count(*) FROM trials t WHERE t.model_name = m.model_name AND t.target = m.c) AS n_target,
  {r6("(SELECT count(*) / 10.0 FROM trials t WHERE t.model_name = m.model_name)", "mean_line")}
FROM (SELECT DISTINCT model_name, c FROM trials, range(10) x(c)) m"""))
def pred_target_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.class_histogram(views.trials(spark, sf_dir), ["model_name"], 10))


_TIERS = ", ".join(str(t) for t in ev.CONFIDENCE_THRESHOLDS)


@query("confidence_tiers", with_ctes([TRIALS, RANKED, SYNC_SCORES, f"""
moved AS (
  SELECT th.t AS threshold, o.top_idx,
    CASE WHEN (s.prob > 0.5)::INT <> s.target THEN (o.top_idx[1] + 5) % 10 ELSE t.target END AS target
  FROM trials t JOIN tops o USING (trial) JOIN sync s ON s.doc_id = t.trial
  JOIN (SELECT unnest([{_TIERS}]::DOUBLE[]) AS t) th ON s.prob > th.t
)"""], f"""
SELECT {r6("threshold", "threshold")}, count(*) AS n, {r6("avg((top_idx[1] = target)::INT)", "accuracy_1")},
  {r6("avg(list_contains(top_idx, target)::INT)", "accuracy_5")},
  {r6(f"sum(({_NEAR1})::INT) / {_EPS}", "accuracy_1_tol1")},
  {r6(f"sum(({_NEAR5})::INT) / {_EPS}", "accuracy_5_tol1")}
FROM moved GROUP BY threshold"""))
def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sync = views.sync_scores(spark, sf_dir).select(
        F.col("doc_id").alias("trial"), F.col("target").alias("sync_target"), F.col("prob").alias("sync_prob"))
    return tidy(ev.confidence_tiers(views.trials(spark, sf_dir).join(sync, "trial"), 10))


@query("non_finite_guard", with_ctes([TRIALS], """
SELECT trial, target, trial % 3 AS kind FROM trials WHERE trial % 41 = 0"""))
def non_finite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.element_at(F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(None).cast("double")),
                       (F.col("trial") % 3 + 1).cast("int"))
    broken = F.concat(F.array(bad), F.slice("logits", 2, 9))
    trials = views.trials(spark, sf_dir).withColumn(
        "logits", F.when(F.col("trial") % 41 == 0, broken).otherwise(F.col("logits")))
    return ev.non_finite_rows(trials).select("trial", "target", (F.col("trial") % 3).alias("kind"))


@query("precision_recall_f1", with_ctes([SYNC_SCORES, """
c AS (SELECT count(*) FILTER (prob > 0.5 AND target = 1) AS tp, count(*) FILTER (prob > 0.5 AND target = 0) AS fp,
             count(*) FILTER (prob <= 0.5 AND target = 1) AS fn FROM sync)"""], f"""
SELECT {r6("coalesce(tp / nullif(tp + fp, 0), 0)", "precision")}, {r6("coalesce(tp / nullif(tp + fn, 0), 0)", "recall")},
  {r6("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "f1")} FROM c"""))
def precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.precision_recall_f1(views.sync_scores(spark, sf_dir)))


_OVR = """
ovr AS (SELECT r.trial, t.model_name, r.cls, r.p AS score, (r.cls = t.target)::INT AS pos
        FROM ranked r JOIN trials t USING (trial))"""


@query("average_precision", with_ctes([TRIALS, RANKED, _OVR, """
d AS (SELECT cls, score, sum(pos) AS pos, count(*) AS n FROM ovr GROUP BY 1, 2)""", """
c AS (SELECT cls, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY cls) AS np
      FROM d WINDOW w AS (PARTITION BY cls ORDER BY score DESC))"""], f"""
SELECT cls, any_value(np)::BIGINT AS n_pos, {r6("sum(pos * tp / seen) / any_value(np)", "average_precision")}
FROM c GROUP BY cls"""))
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = rm.area_metrics(rm.one_vs_rest(views.trials(spark, sf_dir)), ["cls"])
    return tidy(areas.select("cls", "n_pos", "average_precision"))


_AUC = """
rk AS (SELECT model_name, cls, pos, rank() OVER w + (count(*) OVER (PARTITION BY model_name, cls, score) - 1) / 2.0 AS r
       FROM ovr WINDOW w AS (PARTITION BY model_name, cls ORDER BY score))""", """
auc AS (SELECT model_name, cls, sum(pos) AS np, count(*) - sum(pos) AS nn,
        (sum(r) FILTER (pos = 1) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (count(*) - sum(pos))) AS auc
        FROM rk GROUP BY 1, 2)"""


@query("roc_auc", with_ctes([TRIALS, RANKED, _OVR, *_AUC], f"""
SELECT model_name, cls, np::BIGINT AS n_pos, nn::BIGINT AS n_neg, {r6("auc", "roc_auc")} FROM auc"""))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rm.one_vs_rest(views.trials(spark, sf_dir), ["model_name"])
    return tidy(rm.area_metrics(scored, ["model_name", "cls"]).drop("average_precision"))


@query("missing_class_defaults", with_ctes([TRIALS, RANKED, _OVR, *_AUC, """
d AS (SELECT model_name, cls, score, sum(pos) AS pos, count(*) AS n FROM ovr GROUP BY 1, 2, 3)""", """
c AS (SELECT model_name, cls, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen,
             sum(pos) OVER (PARTITION BY model_name, cls) AS np
      FROM d WINDOW w AS (PARTITION BY model_name, cls ORDER BY score DESC))""", """
ap AS (SELECT model_name, cls, sum(pos * tp / seen) / any_value(np) AS ap FROM c GROUP BY 1, 2)"""], f"""
SELECT model_name, {r6("avg(ap)", "map")}, {r6("avg(auc)", "mroc_auc")}
FROM ap JOIN auc USING (model_name, cls) GROUP BY 1
UNION ALL SELECT 'without class 0', 0.0::DOUBLE, 0.5::DOUBLE"""))
def missing_class_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = views.trials(spark, sf_dir)
    gap = trials.where("target <> 0").withColumn("model_name", F.lit("without class 0"))
    return tidy(rm.ranking_report(trials.unionByName(gap), 10))


@query("dprime")
def dprime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(rm.with_dprime(rm.ranking_report(views.trials(spark, sf_dir), 10)))


@query("roc_curve", with_ctes([SYNC_SCORES, """
d AS (SELECT prob, sum(target) AS pos, count(*) - sum(target) AS neg FROM sync GROUP BY 1)""", """
c AS (SELECT prob, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
      FROM d WINDOW w AS (ORDER BY prob DESC))""", """
x AS (SELECT *, lag(tp) OVER w AS ptp, lead(tp) OVER w AS ntp, lag(fp) OVER w AS pfp, lead(fp) OVER w AS nfp
      FROM c WINDOW w AS (ORDER BY prob DESC))"""], f"""
SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'inf'::DOUBLE AS threshold
UNION ALL
SELECT {r6("fp / nn")}, {r6("tp / np")}, {r6("prob")} FROM x
WHERE ptp IS NULL OR ntp IS NULL OR ntp - 2 * tp + ptp <> 0 OR nfp - 2 * fp + pfp <> 0"""))
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(rm.roc_curve(views.sync_scores(spark, sf_dir)))


@query("error_by_sync_range", with_ctes(["""
o AS (SELECT l_tax * 10 - 0.4::DOUBLE AS target, l_discount * 10 - 0.5::DOUBLE + l_quantity / 100 AS pred FROM lineitem)""", """
v AS (SELECT target BETWEEN -0.125 AND 0.045 AS in_sync, 'pred' AS what, pred AS x, NULL::DOUBLE AS sq FROM o
      UNION ALL SELECT target BETWEEN -0.125 AND 0.045, 'target', target, (pred - target) * (pred - target) FROM o)""", """
s AS (SELECT in_sync, what, min(x) AS low, max(x) AS high FROM v GROUP BY 1, 2)""", """
b AS (SELECT v.*, low, high, CASE WHEN high > low THEN least(49, floor((x - low) / ((high - low) / 50))) ELSE 0 END::BIGINT AS bin
      FROM v JOIN s USING (in_sync, what))"""], f"""
SELECT in_sync, what, bin, count(*) AS n, {r6("avg(sq)", "mean_squared_error")}, {r6("any_value(low)", "low")},
  {r6("any_value(high)", "high")} FROM b GROUP BY 1, 2, 3"""))
def error_by_sync_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.table(spark, sf_dir, "lineitem").select(
        (F.col("l_tax") * 10 - 0.4).alias("target"),
        (F.col("l_discount") * 10 - 0.5 + F.col("l_quantity") / 100).alias("pred"))
    return tidy(ev.squared_error_bins(items, -0.125, 0.045))


@query("class_cross_entropy", with_ctes([TRIALS, RANKED], f"""
SELECT model_name, {r6("avg(-ln(p))", "loss")}, count(*) AS n
FROM trials t JOIN ranked r ON r.trial = t.trial AND r.cls = t.target GROUP BY 1"""))
def class_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(losses.class_cross_entropy(views.trials(spark, sf_dir), ["model_name"]))


@query("masked_cross_entropy", with_ctes([TRIALS, RANKED], f"""
SELECT model_name, {r6("avg(-ln(p)) * 2.0", "loss")}, count(*) AS n
FROM trials t JOIN ranked r ON r.trial = t.trial AND r.cls = t.target WHERE t.target <> 0 GROUP BY 1"""))
def masked_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(losses.masked_cross_entropy(views.trials(spark, sf_dir), 0, 2.0, ["model_name"]))
