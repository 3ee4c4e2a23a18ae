"""Prompt expansion, caption statistics and log parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from clipalign.functions import scalars
from clipalign.operators.ordering import carry_last
from clipalign.session import materialize

# The prompt templates of zero-shot classification.
TEMPLATES = [
    "a bad photo of a {c}.",
    "a photo of many {c}.",
    "a sculpture of a {c}.",
    "a photo of the hard to see {c}.",
    "a low resolution photo of the {c}.",
    "a rendering of a {c}.",
    "graffiti of a {c}.",
    "a bad photo of the {c}.",
    "a cropped photo of the {c}.",
    "a tattoo of a {c}.",
    "the embroidered {c}.",
    "a photo of a hard to see {c}.",
    "a bright photo of a {c}.",
    "a photo of a clean {c}.",
    "a photo of a dirty {c}.",
    "a dark photo of the {c}.",
    "a drawing of a {c}.",
    "a photo of my {c}.",
    "the plastic {c}.",
    "a photo of the cool {c}.",
    "a close-up photo of a {c}.",
    "a black and white photo of the {c}.",
    "a painting of the {c}.",
    "a painting of a {c}.",
    "a pixelated photo of the {c}.",
    "a sculpture of the {c}.",
    "a bright photo of the {c}.",
    "a cropped photo of a {c}.",
    "a plastic {c}.",
    "a photo of the dirty {c}.",
    "a jpeg corrupted photo of a {c}.",
    "a blurry photo of the {c}.",
    "a photo of the {c}.",
    "a good photo of the {c}.",
    "a rendering of the {c}.",
    "a {c} in a video game.",
    "a photo of one {c}.",
    "a doodle of a {c}.",
    "a close-up photo of the {c}.",
    "a photo of a {c}.",
    "the origami {c}.",
    "the {c} in a video game.",
    "a sketch of a {c}.",
    "a doodle of the {c}.",
    "a origami {c}.",
    "a low resolution photo of a {c}.",
    "the toy {c}.",
    "a rendition of the {c}.",
    "a photo of the clean {c}.",
    "a photo of a large {c}.",
    "a rendition of a {c}.",
    "a photo of a nice {c}.",
    "a photo of a weird {c}.",
    "a blurry photo of a {c}.",
    "a cartoon {c}.",
    "art of a {c}.",
    "a sketch of the {c}.",
    "a embroidered {c}.",
    "a pixelated photo of a {c}.",
    "itap of the {c}.",
    "a jpeg corrupted photo of the {c}.",
    "a good photo of a {c}.",
    "a plushie {c}.",
    "a photo of the nice {c}.",
    "a photo of the small {c}.",
    "a photo of the weird {c}.",
    "the cartoon {c}.",
    "art of the {c}.",
    "a drawing of the {c}.",
    "a photo of the large {c}.",
    "a black and white photo of a {c}.",
    "the plushie {c}.",
    "a dark photo of a {c}.",
    "itap of a {c}.",
    "graffiti of the {c}.",
    "a toy {c}.",
    "itap of my {c}.",
    "a photo of a cool {c}.",
    "a photo of a small {c}.",
    "a tattoo of the {c}.",
]

CONTEXT_LENGTH = 77


def expand_prompts(names: DataFrame, name: str, templates: Sequence[str]) -> DataFrame:
    """Every name in every template, numbered from zero."""
    filled = F.transform(
        F.array(*[F.lit(t) for t in templates]), lambda t: F.replace(t, F.lit("{c}"), F.col(name)))
    return names.select(name, F.posexplode(filled).alias("template", "prompt"))


def caption_statistics(df: DataFrame, text: str, context_length: int = CONTEXT_LENGTH) -> DataFrame:
    """Add the word count, the length with start and end mark, and what the context length cuts off."""
    counted = df.withColumn("_words", scalars.caption_words(F.col(text)))
    n = F.size("_words").cast("bigint")
    return counted.select(
        *[c for c in df.columns if c != text],
        n.alias("n_words"),
        F.least(n + 2, F.lit(context_length)).alias("used_length"),
        (n + 2 > context_length).alias("truncated"),
        F.get("_words", F.lit(0)).alias("first_word"),
        F.get("_words", F.least(n, F.lit(context_length - 2)).cast("int") - 1).alias("last_kept_word"),
    )


# Names and patterns of the progress log.
PROGRESS_METRICS = [
    "Loss", "Segment_contrastive_loss", "Precision", "Precision_a", "Precision_v", "Accuracy", "Acc", "LR",
]
AVERAGED_METRICS = PROGRESS_METRICS[:-1]
NUMBER = r"[-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?"
PROGRESS_LINE = (
    r"\|\s+INFO\s+\|\s+(Train|Valid|Val|Eval|Test).*?Epoch:\s*(\d+).*?\[\s*(\d+)\s*/\s*(\d+)"
)
METRIC_PIECE = rf"\b{{}}\s*:\s*(?:{NUMBER})(?:\s*\((?:{NUMBER})\))?"
EPOCH_LOSS_LINE = r"(train|valid) \((\d+)\): total_loss ([0-9.]+);"
EPOCH_METRICS_LINE = (
    r"(train|valid) \((\d+)\) metrics: .*?'accuracy_1': ([0-9.]+).*?'accuracy_5': ([0-9.]+)"
    r".*?'accuracy_1_tol1': ([0-9.]+)"
)


def _number(line: str, pattern: str, group: int):
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit("")).cast("double")


def parse_progress(lines: DataFrame, value: str = "value", file: str = "file") -> DataFrame:
    """Distinct progress rows of each log with current and running values per metric.

    ``<metric>_plot`` is the running value when the row's log has any for that metric, otherwise the current one.
    """
    head = F.regexp_extract(value, PROGRESS_LINE, 0)
    pieces = {
        # one search per metric; the numbers are then cut from the short match
        m.lower(): F.when(F.contains(F.col(value), F.lit(m)), F.regexp_extract(value, METRIC_PIECE.format(m), 0))
        for m in PROGRESS_METRICS
    }
    # inline keeps the filters below from being pushed under the searches, which would run them again
    cut = lines.select(F.inline(F.array(F.struct(
        F.col(file), head.alias("_head"), *[p.alias(f"_{m}") for m, p in pieces.items()])))).where("_head <> ''")
    parts = F.split(F.regexp_replace("_head", PROGRESS_LINE, "$1,$2,$3,$4"), ",")
    phase = F.get(parts, F.lit(0))
    fields = [F.col(file), F.when(phase.isin("Valid", "Val"), "Eval").otherwise(phase).alias("phase")]
    for position, name in ((1, "epoch"), (2, "seen_in_phase"), (3, "phase_total")):
        fields.append(F.get(parts, F.lit(position)).cast("bigint").alias(name))
    for m in pieces:
        fields += [_number(f"_{m}", rf":\s*({NUMBER})", 1).alias(m), _number(f"_{m}", rf"\(({NUMBER})\)$", 1).alias(f"{m}_avg")]
    found = F.concat_ws("", *[f"_{m}" for m in pieces]) != ""
    parsed = materialize(cut.where(found).select(*fields).withColumn(
        "phase_progress", F.col("epoch") * F.col("phase_total") + F.col("seen_in_phase")).distinct())
    names = [m.lower() for m in AVERAGED_METRICS]
    averaged = parsed.groupBy(file).agg(F.struct(*[F.count(f"{m}_avg").alias(m) for m in names]).alias("_has"))
    plots = [F.when(F.col(f"_has.{m}") > 0, F.col(f"{m}_avg")).otherwise(F.col(m)).alias(f"{m}_plot") for m in names]
    return parsed.join(averaged, file).select(*[F.col(c) for c in parsed.columns], *plots)


def parse_epochs(lines: DataFrame, line_no: str = "line_no", value: str = "value", file: str = "file") -> DataFrame:
    """Epoch loss rows of each log, each with the latest metrics line that follows it before the next loss of its epoch."""
    is_loss, is_metrics = F.col(value).rlike(EPOCH_LOSS_LINE), F.col(value).rlike(EPOCH_METRICS_LINE)
    head = r"(train|valid) \((\d+)\)"
    marks = lines.where(is_loss | is_metrics).select(
        F.col(file),
        F.regexp_extract(value, head, 1).alias("phase"),
        F.regexp_extract(value, head, 2).cast("bigint").alias("epoch"),
        F.col(line_no),
        F.when(is_loss, F.col(line_no)).alias("loss_line"),
        _number(value, EPOCH_LOSS_LINE, 3).alias("loss"),
        F.when(is_metrics, F.struct(*[
            _number(value, EPOCH_METRICS_LINE, g).alias(n)
            for g, n in ((3, "accuracy_1"), (4, "accuracy_5"), (5, "accuracy_1_tol1"))])).alias("metrics"),
    )
    owned = carry_last(marks, [F.col(line_no)], "loss_line", [file, "phase", "epoch"], held="owner").where("owner is not null")
    return owned.groupBy(file, "phase", "epoch", F.col("owner").alias(line_no)).agg(
        F.max("loss").alias("loss"),
        F.max_by("metrics", F.when(F.col("metrics").isNotNull(), F.col(line_no))).alias("m"),
    ).select(file, "phase", "epoch", line_no, "loss", "m.accuracy_1", "m.accuracy_5", "m.accuracy_1_tol1")
