"""Domain tables seen through the relational test tables: clips, segments, logits, tokens and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign.functions import vectors
from clipalign.operators.similarity import zero_shot_logits

# Label order of the event types used as cluster ids.
EVENT_CLUSTERS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per clip with stream lengths in frames; audio is up to six frames' worth of samples short."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("clip_id"),
        F.col("source").alias("video"),
        F.col("lang").alias("label"),
        F.col("n_chars").alias("v_len"),
        (F.col("n_chars") * 640 - (F.col("doc_id") % 7) * 160).alias("a_len"),
        F.lit(25).cast("bigint").alias("v_fps"),
        F.lit(16000).cast("bigint").alias("a_fps"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment features: twenty vectors make one clip of ten segments with a visual and an audio part."""
    e = table(spark, sf_dir, "embeddings")
    vec = F.col("vec_id")
    return e.select(
        F.floor(vec / 20).alias("video"),
        F.floor((vec % 20) / 2).alias("seg"),
        F.when(vec % 2 == 0, "v").otherwise("a").alias("modality"),
        F.floor(vec / 2).alias("pair"),
        vectors.as_double(F.col("embedding")).alias("feat"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-shot logits over ten classes for every vector, with shard, model and target class."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("trial"),
        F.col("label").cast("bigint").alias("target"),
        vectors.as_double(F.col("embedding")).alias("feat"),
    )
    scored = zero_shot_logits(e, e, feature="feat", label="target")
    return scored.select(
        "trial",
        F.when(F.col("trial") % 2 == 0, "base").otherwise("tuned").alias("model_name"),
        F.concat(
            F.lit("/shards/shard-"), F.col("trial") % 8, F.lit(".tar::clip"), F.col("trial"), F.lit(".mp4")
        ).alias("sample_id"),
        "target",
        "logits",
    )


def sync_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary sync target and probability for every labelled clip."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("target"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    prob = ((F.col("n_chars") * 7919) % 997 + 1) / F.lit(999.0)
    return labels.join(docs, "doc_id").select("doc_id", "target", prob.alias("prob"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch tokens: one per event, with time frames in the day, a frequency band and a cluster."""
    e = table(spark, sf_dir, "events")
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    band = F.floor(F.col("value")).cast("bigint") % 112
    cluster = F.array_position(F.array(*[F.lit(c) for c in EVENT_CLUSTERS]), F.col("event_type")) - 1
    return e.select(
        F.col("event_id").alias("token_id"),
        F.col("user_id").alias("video"),
        second.cast("bigint").alias("t0"),
        (second + 1 + F.col("event_id") % 8).cast("bigint").alias("t1"),
        band.alias("f0"),
        (band + 16).alias("f1"),
        F.when(F.col("event_id") % 11 == 0, F.lit(-1)).otherwise(cluster).cast("bigint").alias("cluster"),
        (F.col("event_id") % 3).alias("parent"),
        "value",
    )


def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean value per event type as the metric history of a run."""
    e = table(spark, sf_dir, "events")
    return (
        e.withColumn("epoch", (F.dayofyear("ts") - 1).cast("bigint"))
        .groupBy(F.col("event_type").alias("run"), "epoch")
        .agg(F.round(F.avg("value"), 6).alias("metric"))
    )


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timing samples: the stage is the event type and the seconds are the value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("stage"), "event_id", F.col("value").alias("seconds"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-log lines written from the events, some without a metric and some repeated."""
    e = table(spark, sf_dir, "events")
    phase = F.element_at(F.array(*[F.lit(p) for p in ("Train", "Valid", "Val", "Eval", "Test")]),
                         (F.col("event_id") % 5 + 1).cast("int"))
    metrics = F.when(F.col("event_id") % 13 == 0, F.lit("no metric here")).otherwise(
        F.concat(
            F.lit("Loss: "), F.format_string("%.2f", F.col("value")),
            F.when(F.col("event_id") % 2 == 0, F.concat(
                F.lit(" ("), F.format_string("%.2f", F.col("value") * 2), F.lit(")"))).otherwise(F.lit("")),
            F.lit(" Precision_a: 0."), (F.col("event_id") % 10).cast("string"),
        )
    )
    line = F.concat(
        F.lit("12:00:00 | INFO | "), phase, F.lit(" Epoch: "), (F.dayofyear("ts") - 1).cast("string"),
        F.lit(" [ "), (F.col("event_id") % 977).cast("string"), F.lit("/1000 (5%)]\t"), metrics,
    )
    return e.select(F.col("event_id").alias("line_no"), line.alias("value"))
