"""Trial rows from logits, and the accuracy reports built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clipalign.functions import scalars, vectors
from clipalign.operators.ordering import exact_quantiles
from clipalign.session import broadcast_if_small, materialize

# Column order of the trial table.
TRIAL_FIELDS = [
    "model_name", "exp_name", "iter_idx", "batch_idx", "sample_idx_in_batch", "sample_id", "status", "error",
    "target_offset_sec", "target_class_index", "pred_offset_sec", "pred_class_index", "pred_probability",
    "top1_correct", "top1_pm1_class_correct", "top5_correct", "abs_class_error", "abs_offset_error_sec",
    "v_start_i_sec", "v_end_i_sec", "a_start_i_sec", "a_end_i_sec", "crop_duration_sec",
    "pred_a_start_i_sec", "pred_a_end_i_sec",
] + [
    f"top{rank}_{part}" for rank in range(1, 6) for part in ("offset_sec", "probability", "class_index", "logit")
]

# Column order of the summary table.
SUMMARY_FIELDS = [
    "model_name", "exp_name", "num_clips", "data_iter", "num_trials", "num_errors", "num_classes",
    "grid_min_sec", "grid_max_sec", "grid_step_sec", "accuracy_1", "accuracy_1_pm1_class", "accuracy_5",
    "mean_abs_class_error", "median_abs_class_error", "mean_abs_offset_error_sec",
    "median_abs_offset_error_sec", "accuracy_1_median_over_all_classes_missing_as_zero",
    "accuracy_1_median_over_present_classes", "target_count_per_class_json",
    "correct_target_class_count_per_tar_json", "correct_target_offset_sec_count_per_tar_json",
    "zero_offset_target_class_index", "zero_offset_num_trials", "zero_offset_pred_class_count_json",
    "zero_offset_pred_class_frequency_json",
]

# Confidence thresholds of the tiered report and the class shift for a wrong sync call.
CONFIDENCE_THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
WRONG_SYNC_SHIFT = 5

DEFAULT_CROP_SEC = 5.0
TOLERANCE_EPS = 1e-7


def offset_grid(low: float, high: float, size: int) -> list[float]:
    """Evenly spaced offsets, both ends included, to six places."""
    if size < 3:
        raise ValueError("a class grid needs at least three points")
    return [round(low + i * (high - low) / (size - 1), 6) for i in range(size)]


def grid_column(grid: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(g)) for g in grid])


def zero_class(grid: Sequence[float]) -> int | None:
    """Index of the grid point closest to zero when it is zero to within 1e-6."""
    nearest = min(range(len(grid)), key=lambda i: abs(grid[i]))
    return nearest if abs(grid[nearest]) <= 1e-6 else None


def top_k(trials: DataFrame, grid: Sequence[float], k: int = 5) -> DataFrame:
    """Add ``top{r}_*`` columns for ranks 1..5 and ``top_idx``; no shuffle."""
    depth = min(max(k, 5), len(grid))
    probs = vectors.softmax(F.col("logits"))
    ranked = trials.withColumn("top_idx", vectors.top_classes(F.col("logits"), depth)).withColumn("_probs", probs)
    columns = []
    for rank in range(1, 6):
        cls = F.get("top_idx", F.lit(rank - 1))
        columns += [
            F.get(grid_column(grid), cls).alias(f"top{rank}_offset_sec"),
            F.get("_probs", cls).alias(f"top{rank}_probability"),
            cls.cast("bigint").alias(f"top{rank}_class_index"),
            F.get("logits", cls).alias(f"top{rank}_logit"),
        ]
    return ranked.select(*[c for c in ranked.columns if c != "_probs"], *columns)


def trial_rows(trials: DataFrame, grid: Sequence[float], exp_name: str = "", batch_size: int = 32) -> DataFrame:
    """The full trial table. A batch with one unusable row turns all its rows into error rows.

    Needs ``model_name, trial, sample_id, target, logits``; uses ``iter_idx``, ``target_offset``, ``v_start``,
    ``a_start`` and ``crop`` where present. ``trial`` numbers the rows of a model in loader order.
    """
    has = set(trials.columns)
    target = F.col("target").cast("int")
    usable = (
        F.col("logits").isNotNull() & (F.size("logits") == len(grid)) & F.col("target").between(0, len(grid) - 1)
    )
    base = trials.withColumn("batch_idx", F.floor(F.col("trial") / batch_size)).withColumn(
        "_bad", ~F.coalesce(usable, F.lit(False)))
    failed = base.where("_bad").select("model_name", "batch_idx").distinct().withColumn("_failed", F.lit(True))
    marked = base.join(broadcast_if_small(failed), ["model_name", "batch_idx"], "left")
    ok = F.col("_failed").isNull()
    good = top_k(marked.withColumn("logits", F.when(ok, F.col("logits"))), grid)
    offset = F.col("target_offset") if "target_offset" in has else F.get(grid_column(grid), target)
    v_start = F.col("v_start").cast("double") if "v_start" in has else F.lit(0.0)
    crop = F.col("crop").cast("double") if "crop" in has else F.lit(DEFAULT_CROP_SEC)
    a_start = F.col("a_start").cast("double") if "a_start" in has else v_start + offset
    pred, pred_offset = F.col("top1_class_index"), F.col("top1_offset_sec")
    values = {
        "exp_name": F.lit(exp_name),
        "iter_idx": F.col("iter_idx") if "iter_idx" in has else F.lit(0).cast("bigint"),
        "batch_idx": F.col("batch_idx"),
        "sample_idx_in_batch": F.col("trial") % batch_size,
        "status": F.when(ok, "ok").otherwise("error"),
        "error": F.when(ok, "").otherwise("batch has unusable logits or target"),
    }
    measured = {
        "target_offset_sec": offset,
        "target_class_index": F.col("target"),
        "pred_offset_sec": pred_offset,
        "pred_class_index": pred,
        "pred_probability": F.col("top1_probability"),
        "top1_correct": (pred == F.col("target")).cast("bigint"),
        "top1_pm1_class_correct": (F.abs(pred - F.col("target")) <= 1).cast("bigint"),
        "top5_correct": F.array_contains(F.slice("top_idx", 1, 5), target).cast("bigint"),
        "abs_class_error": F.abs(pred - F.col("target")),
        "abs_offset_error_sec": F.abs(pred_offset - offset),
        "v_start_i_sec": v_start,
        "v_end_i_sec": v_start + crop,
        "a_start_i_sec": a_start,
        "a_end_i_sec": a_start + crop,
        "crop_duration_sec": crop,
        "pred_a_start_i_sec": v_start + pred_offset,
        "pred_a_end_i_sec": v_start + pred_offset + crop,
    }
    values |= {name: F.when(ok, value) for name, value in measured.items()}
    return good.select(*[values.get(f, F.col(f)).alias(f) for f in TRIAL_FIELDS])


def trial_summary(rows: DataFrame, grid: Sequence[float], groups: Sequence[str] = ("model_name",)) -> DataFrame:
    """Accuracy and error figures per group. Error rows are counted and otherwise left out.

    Class errors take few distinct values. Errors in seconds may take as many as there are trials, so their median comes from running
    counts.
    """
    ok = F.col("status") == "ok"
    # one pass over the rows; everything below reads the few distinct cells
    cells = materialize(rows.groupBy(
        *groups, ok.alias("_ok"), "target_class_index", "abs_class_error", "abs_offset_error_sec"
    ).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("top1_correct").alias("_t1"),
        F.sum("top1_pm1_class_correct").alias("_pm1"), F.sum("top5_correct").alias("_t5")))
    counted = F.sum(F.when(F.col("_ok"), F.col("_n")).otherwise(0))

    def mean(hits: Column) -> Column:
        return F.try_divide(F.sum(F.when(F.col("_ok"), hits)).cast("double"), counted)

    def median(value: str) -> Column:
        return F.percentile(F.when(F.col("_ok"), F.col(value)), F.lit(0.5), F.col("_n"))

    figures = cells.groupBy(*groups).agg(
        counted.alias("num_trials"),
        F.sum(F.when(~F.col("_ok"), F.col("_n")).otherwise(0)).alias("num_errors"),
        mean(F.col("_t1")).alias("accuracy_1"),
        mean(F.col("_pm1")).alias("accuracy_1_pm1_class"),
        mean(F.col("_t5")).alias("accuracy_5"),
        mean(F.col("abs_class_error") * F.col("_n")).alias("mean_abs_class_error"),
        median("abs_class_error").alias("median_abs_class_error"),
        mean(F.col("abs_offset_error_sec") * F.col("_n")).alias("mean_abs_offset_error_sec"),
    ).join(exact_quantiles(
        cells.where("_ok"), "abs_offset_error_sec", {"median_abs_offset_error_sec": 0.5}, list(groups), weight="_n"), list(groups), "left")
    per_class = cells.where("_ok").groupBy(*groups, "target_class_index").agg(
        (F.sum("_t1") / F.sum("_n")).alias("acc"))
    absent = F.array_repeat(F.lit(0.0), F.lit(len(grid)) - F.count(F.lit(1)).cast("int"))
    medians = per_class.groupBy(*groups).agg(
        F.array_sort(F.concat(F.collect_list("acc"), absent)).alias("_all"),
        F.percentile("acc", F.lit(0.5)).alias("accuracy_1_median_over_present_classes"),
    )
    half = (len(grid) - 1) / 2
    median_all = (F.get("_all", F.lit(int(half))) + F.get("_all", F.lit(int(half + 0.5)))) / 2
    medians = medians.select(
        *groups, median_all.alias("accuracy_1_median_over_all_classes_missing_as_zero"),
        "accuracy_1_median_over_present_classes")
    return figures.join(medians, list(groups), "left").select(
        "*",
        F.lit(len(grid)).cast("bigint").alias("num_classes"),
        F.lit(float(min(grid))).alias("grid_min_sec"),
        F.lit(float(max(grid))).alias("grid_max_sec"),
        F.lit(float(grid[1] - grid[0])).alias("grid_step_sec"),
    )


def class_frame(df: DataFrame, groups: Sequence[str], n_classes: int, name: str) -> DataFrame:
    """Every class of the grid for every group found in ``df``, a table of class counts."""
    classes = F.sequence(F.lit(0).cast("bigint"), F.lit(n_classes - 1).cast("bigint"))
    return df.select(*groups).distinct().select(*groups, F.explode(classes).alias(name))


def _scored(trials: DataFrame, depth: int = 5) -> DataFrame:
    return trials.withColumn("top_idx", vectors.top_classes(F.col("logits"), depth))


def _hit(k: int) -> Column:
    return F.array_contains(F.slice("top_idx", 1, k), F.col("target").cast("int")).cast("double")


def _near_hit(k: int) -> Column:
    target = F.col("target").cast("int")
    return F.exists(F.slice("top_idx", 1, k), lambda c: F.abs(c - target) <= 1).cast("double")


def topk_accuracy(trials: DataFrame, groups: Sequence[str], ks: Sequence[int] = (1, 5)) -> DataFrame:
    return _scored(trials, max(ks)).groupBy(*groups).agg(*[F.avg(_hit(k)).alias(f"accuracy_{k}") for k in ks])


def binary_accuracy(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Two classes: predict class 1 when its probability is above one half."""
    hit = (F.col("prob") > 0.5).cast("bigint") == F.col("target")
    return scores.groupBy(*groups).agg(F.avg(hit.cast("double")).alias("accuracy_1"))


def _tolerance(k: int) -> Column:
    return F.sum(_near_hit(k)) / (F.count(F.lit(1)) + F.lit(TOLERANCE_EPS))


def tolerance_accuracy(
    trials: DataFrame, groups: Sequence[str], n_classes: int, ks: Sequence[int] = (1, 5), doubt_class: bool = False
) -> DataFrame:
    """Share of trials with a top-k class at most one away; the last class is left out when it means doubt."""
    kept = trials.where(F.col("target") != n_classes - 1) if doubt_class else trials
    return _scored(kept, max(ks)).groupBy(*groups).agg(*[_tolerance(k).alias(f"accuracy_{k}_tol1") for k in ks])


def per_class_metrics(trials: DataFrame, groups: Sequence[str], n_classes: int) -> DataFrame:
    """Accuracy and tolerance per target class; classes without trials stay empty."""
    metrics = materialize(_scored(trials).groupBy(*groups, "target").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_hit(1)).alias("accuracy_1"),
        F.avg(_hit(5)).alias("accuracy_5"),
        _tolerance(1).alias("accuracy_1_tol1"),
        _tolerance(5).alias("accuracy_5_tol1"),
    ))
    frame = class_frame(metrics, groups, n_classes, "target")
    return frame.join(metrics, [*groups, "target"], "left").fillna(0, ["n"])


def class_histogram(trials: DataFrame, groups: Sequence[str], n_classes: int) -> DataFrame:
    """Predictions and targets per class, with the mean line of each."""
    pred = F.get(vectors.top_classes(F.col("logits"), 1), F.lit(0)).cast("bigint")
    marks = trials.select(*groups, F.inline(F.array(
        F.struct(pred.alias("cls"), F.lit(1).alias("p"), F.lit(0).alias("t")),
        F.struct(F.col("target").alias("cls"), F.lit(0).alias("p"), F.lit(1).alias("t")),
    )))
    counts = materialize(marks.groupBy(*groups, "cls").agg(F.sum("p").alias("n_pred"), F.sum("t").alias("n_target")))
    totals = counts.groupBy(*groups).agg((F.sum("n_pred") / n_classes).alias("mean_line"))
    frame = class_frame(counts, groups, n_classes, "cls")
    return (
        frame.join(counts, [*groups, "cls"], "left").fillna(0, ["n_pred", "n_target"])
        .join(totals, list(groups))
    )


def confidence_tiers(
    trials: DataFrame, n_classes: int, thresholds: Sequence[float] = tuple(CONFIDENCE_THRESHOLDS)
) -> DataFrame:
    """Offset metrics on the trials that the sync model trusts, per threshold.

    Needs ``sync_prob`` and ``sync_target``. Where the sync call is wrong, the target moves off the
    prediction. Rows are summed once per number of thresholds passed, then the few sums are accumulated.
    """
    sync_pred = (F.col("sync_prob") > 0.5).cast("bigint")
    thresholds = sorted(thresholds)
    scored = _scored(trials)
    pred = F.get("top_idx", F.lit(0))
    moved = F.when(sync_pred != F.col("sync_target"), (pred + WRONG_SYNC_SHIFT) % n_classes).otherwise(F.col("target"))
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    passed = F.size(F.filter(limits, lambda t: F.col("sync_prob") > t))
    sums = (
        scored.withColumn("target", moved.cast("bigint")).withColumn("_passed", passed).where("_passed > 0")
        .groupBy("_passed")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(_hit(1)).alias("h1"), F.sum(_hit(5)).alias("h5"),
             F.sum(_near_hit(1)).alias("t1"), F.sum(_near_hit(5)).alias("t5"))
    )
    tiers = sums.withColumn("tier", F.explode(F.sequence(F.lit(1), F.col("_passed"))))
    n = F.sum("n")
    return tiers.groupBy("tier").agg(
        n.alias("n"),
        (F.sum("h1") / n).alias("accuracy_1"),
        (F.sum("h5") / n).alias("accuracy_5"),
        (F.sum("t1") / (n + TOLERANCE_EPS)).alias("accuracy_1_tol1"),
        (F.sum("t5") / (n + TOLERANCE_EPS)).alias("accuracy_5_tol1"),
    ).withColumn("threshold", F.get(limits, F.col("tier") - 1)).drop("tier")


def non_finite_rows(trials: DataFrame) -> DataFrame:
    """Trials with a missing, infinite or not-a-number logit."""
    return trials.where(~vectors.all_finite(F.col("logits")))


def precision_recall_f1(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Binary precision, recall and F1 of ``prob > 0.5``; zero where undefined."""
    pred, truth = F.col("prob") > 0.5, F.col("target") == 1
    counts = scores.groupBy(*groups).agg(
        F.count_if(pred & truth).alias("tp"), F.count_if(pred & ~truth).alias("fp"),
        F.count_if(~pred & truth).alias("fn"))
    zero = F.lit(0.0)
    return counts.select(
        *groups,
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero).alias("recall"),
        F.coalesce(F.try_divide(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")), zero).alias("f1"),
    )


def squared_error_bins(
    df: DataFrame, sync_low: float, sync_high: float, bins: int = 50, target: str = "target", pred: str = "pred"
) -> DataFrame:
    """Squared errors and histograms of predictions and targets for in-sync and out-of-sync targets.

    Both histograms of a range share its own value span, cut into equal bins with a closed last one.
    """
    ranged = df.withColumn("in_sync", F.col(target).between(sync_low, sync_high))
    values = ranged.select("in_sync", F.inline(F.array(
        F.struct(F.lit("pred").alias("what"), F.col(pred).alias("x"), F.lit(None).cast("double").alias("sq")),
        F.struct(F.lit("target").alias("what"), F.col(target).alias("x"),
                 F.pow(F.col(pred) - F.col(target), 2).alias("sq")),
    )))
    spans = values.groupBy("in_sync", "what").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    # at most four spans
    placed = values.join(F.broadcast(spans), ["in_sync", "what"])
    width = (F.col("high") - F.col("low")) / bins
    index = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / width))).otherwise(0)
    return placed.groupBy("in_sync", "what", index.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("sq").alias("mean_squared_error"), F.min("low").alias("low"),
        F.max("high").alias("high"))


def zero_offset_confusion(rows: DataFrame, grid: Sequence[float], groups: Sequence[str] = ("model_name",)) -> DataFrame:
    """For trials whose true offset is zero: count and share of every predicted class."""
    zero = zero_class(grid)
    hit = (F.col("status") == "ok") & (F.col("target_class_index") == F.lit(zero))
    counts = materialize(rows.groupBy(*groups, F.col("pred_class_index").alias("cls")).agg(F.count_if(hit).alias("n")))
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("total"))
    frame = class_frame(counts, groups, len(grid), "cls")
    joined = frame.join(counts, [*groups, "cls"], "left").join(totals, list(groups), "left").fillna(0, ["n", "total"])
    return joined.select(
        *groups, "cls", F.get(grid_column(grid), F.col("cls").cast("int")).alias("pred_offset_sec"), "n",
        F.coalesce(F.try_divide("n", "total"), F.lit(0.0)).alias("frequency"))


def class_counts(rows: DataFrame, n_classes: int, groups: Sequence[str] = ("model_name",)) -> DataFrame:
    """Target count per class as a JSON map with string keys in text order; absent classes count zero."""
    counts = materialize(rows.groupBy(*groups, F.col("target_class_index").alias("cls")).agg(
        F.count_if(F.col("status") == "ok").alias("n")))
    full = class_frame(counts, groups, n_classes, "cls").join(counts, [*groups, "cls"], "left").fillna(0, ["n"])
    entries = F.array_sort(F.collect_list(F.struct(F.col("cls").cast("string").alias("key"), "n")))
    return full.groupBy(*groups).agg(F.to_json(F.map_from_entries(entries)).alias("target_count_per_class_json"))


def shard_counts(rows: DataFrame, groups: Sequence[str] = ("model_name",)) -> DataFrame:
    """Correct trials per shard and class, with their offset key."""
    correct = rows.where("top1_correct = 1")
    return correct.groupBy(
        *groups,
        scalars.shard_name(F.col("sample_id")).alias("shard"),
        F.col("target_class_index").alias("cls"),
        scalars.six_digit_key(F.col("target_offset_sec")).alias("offset_key"),
    ).agg(F.count(F.lit(1)).alias("n"))


def shard_rollup(rows: DataFrame, groups: Sequence[str] = ("model_name",)) -> DataFrame:
    """One row per shard: correct counts by class and by offset as sorted JSON maps, and the shard total."""
    return _shard_maps(rows, groups).select(
        *groups, "shard", F.to_json("class_count").alias("class_count_json"), F.to_json("offset_count").alias("offset_count_json"), "n_correct")


def _shard_maps(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Counts per shard summed once by class and once by offset key: a class may have several offsets, and an offset several classes."""
    counted = shard_counts(rows, groups).select(*groups, "shard", "n", F.inline(F.array(
        F.struct(F.lit("class").alias("what"), F.col("cls").cast("string").alias("key")),
        F.struct(F.lit("offset").alias("what"), F.col("offset_key").alias("key")))))
    entries = counted.groupBy(*groups, "shard", "what", "key").agg(F.sum("n").alias("n"))

    def counts(what: str) -> Column:
        own = F.when((F.col("what") == what) & F.col("key").isNotNull(), F.struct("key", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(own))).alias(f"{what}_count")

    return entries.groupBy(*groups, "shard").agg(
        counts("class"), counts("offset"), F.sum(F.when(F.col("what") == "class", F.col("n"))).alias("n_correct"))


def full_summary(
    rows: DataFrame, grid: Sequence[float], data_iter: int, exp_name: str = "", num_clips: int | None = None, shard_maps: bool = True
) -> DataFrame:
    """All summary fields per model, with the model's own count of clips unless ``num_clips`` is given.

    The two maps over shards put all shards of a model into one value. ``shard_rollup`` holds the same counts row by row; a caller with
    very many shards writes that table and asks for a summary without the maps. A grid without a zero class gives zero trials and zero maps.
    """
    key = ["model_name"]
    zero = zero_class(grid)
    rows = materialize(rows.select(
        "model_name", "sample_id", "status", "target_class_index", "target_offset_sec", "pred_class_index", "top1_correct",
        "top1_pm1_class_correct", "top5_correct", "abs_class_error", "abs_offset_error_sec"))
    summary = trial_summary(rows, grid).join(class_counts(rows, len(grid)), key, "left")
    clips = rows.select(*key, "sample_id").distinct().groupBy(*key).agg(F.count("sample_id").alias("num_clips"))
    summary = summary.join(clips, key, "left")
    if num_clips is not None:
        summary = summary.withColumn("num_clips", F.lit(num_clips).cast("bigint"))
    if shard_maps:
        def nested(column: str) -> Column:
            listed = F.array_sort(F.collect_list(F.struct("shard", F.map_entries(column).alias("counts"))))
            return F.to_json(F.map_from_entries(F.transform(listed, lambda e: F.struct(e["shard"], F.map_from_entries(e["counts"])))))

        names = {"class_count": "correct_target_class_count_per_tar_json", "offset_count": "correct_target_offset_sec_count_per_tar_json"}
        maps = _shard_maps(rows, key).where("shard IS NOT NULL").groupBy(*key).agg(*[nested(c).alias(n) for c, n in names.items()])
        summary = summary.join(maps, key, "left").fillna("{}", list(names.values()))
    if zero is None:
        classes = F.sequence(F.lit(0).cast("bigint"), F.lit(len(grid) - 1).cast("bigint"))
        frame = rows.select(*key).distinct().select(*key, F.explode(classes).alias("cls"))
        confusion = frame.select(
            *key, "cls", F.get(grid_column(grid), F.col("cls").cast("int")).alias("pred_offset_sec"), F.lit(0).cast("bigint").alias("n"),
            F.lit(0.0).alias("frequency"))
    else:
        confusion = zero_offset_confusion(rows, grid)
    counts = F.array_sort(F.collect_list(F.struct(F.col("cls").cast("string").alias("key"), F.col("n").alias("v"))))
    shares = F.array_sort(F.collect_list(F.struct(
        F.col("cls").cast("string").alias("key"),
        F.struct(F.col("n").alias("count"), "frequency", "pred_offset_sec").alias("v"))))
    zero_maps = confusion.groupBy(*key).agg(
        F.sum("n").alias("zero_offset_num_trials"),
        F.to_json(F.map_from_entries(counts)).alias("zero_offset_pred_class_count_json"),
        F.to_json(F.map_from_entries(shares)).alias("zero_offset_pred_class_frequency_json"))
    summary = summary.join(zero_maps, key, "left")
    constants = {
        "exp_name": F.lit(exp_name), "data_iter": F.lit(data_iter), "zero_offset_target_class_index": F.lit(zero).cast("bigint"),
    }
    for name, value in constants.items():
        summary = summary.withColumn(name, value)
    return summary.select(*[F.col(f) if f in summary.columns else F.lit(None).cast("string").alias(f) for f in SUMMARY_FIELDS])
