"""Readers and writers of the plain files around a corpus: metadata, id lists, fixed offsets, reports."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign.operators.evaluation import SUMMARY_FIELDS, TRIAL_FIELDS
from clipalign.operators.ordering import row_numbers
from clipalign.sources.epoch_sink import append_epochs

# Older names of the start column, and the column order of offset files without a header.
START_NAMES = {"vstart_sec": "v_start_i_sec", "v_start_sec": "v_start_i_sec"}
HEADERLESS_OFFSETS = "path string, vstart_sec double, offset_sec double, oos_target int"
# A default, for callers that name no suffixes.
MEDIA_SUFFIXES = ("mp4", "mkv", "webm", "mov", "avi", "flv", "m4v", "mpg", "mpeg")


def read_clip_meta(spark: SparkSession, path: str) -> DataFrame:
    """Headerless quoted CSV ``id, start, label, split``."""
    schema = "video_id string, start_sec int, label string, split string"
    return spark.read.schema(schema).option("quote", '"').option("escape", '"').csv(path)


def read_tagged_meta(spark: SparkSession, path: str) -> DataFrame:
    """Headerless quoted CSV ``folder/id, start, end, "1,2,3", phase``."""
    schema = "dir_vid string, start_sec double, end_sec double, targets string, phase string"
    return spark.read.schema(schema).option("quote", '"').option("escape", '"').csv(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("idx int, mid string, label string").option("escape", '"').csv(path)


def read_class_flags(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``class, is_sparse`` with a header line."""
    return spark.read.schema("class string, is_sparse string").option("sep", "\t").option("header", True).csv(path)


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """Ids of every ``*.txt`` file below a folder with the file that names them; empty lines are no ids."""
    lines = spark.read.options(recursiveFileLookup="true", pathGlobFilter="*.txt").text(path)
    return lines.select(
        F.col("value").alias("clip_id"), F.col("_metadata.file_path").alias("file_path")).where("clip_id <> ''")


def fixed_offset_name(split: str, size: int | None, crop_sec: float, low: float, high: float) -> str:
    """File name of the fixed offsets for one set of parameters; no size means the binary form."""
    crop = int(crop_sec) if crop_sec == int(crop_sec) else crop_sec
    kind = f"size{size}" if size is not None else "unifbin"
    return f"{split}_{kind}_crop{crop}_min{low:.2f}_max{high:.2f}.csv"


def read_fixed_offsets(spark: SparkSession, paths: Sequence[str], header: bool = True) -> DataFrame:
    """Offsets of all splits under one set of names and types; the columns of each path are those of its own header."""
    types = {"offset_sec": "double", "v_start_i_sec": "double", "oos_target": "int"}
    found = None
    for path in paths:
        raw = spark.read.option("header", True).csv(path) if header else spark.read.schema(HEADERLESS_OFFSETS).csv(path)
        named = raw.withColumnsRenamed({old: new for old, new in START_NAMES.items() if old in raw.columns})
        typed = named.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in named.columns])
        found = typed if found is None else found.unionByName(typed, allowMissingColumns=True)
    return found


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """MD5 of every file below a folder, read in pieces, so that files of any length fit."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = []
            for name in batch["path"]:
                system, inner = fs.FileSystem.from_uri(name if "://" in name else re.sub(r"^file:", "", name))
                total = hashlib.md5()
                with system.open_input_stream(inner, compression=None) as stream:
                    while piece := stream.read(8 << 20):
                        total.update(piece)
                sums.append(total.hexdigest())
            yield batch.assign(md5=sums)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.repartition("path").mapInPandas(digest, "path string, length long, md5 string")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line_no`` (from 1) and ``value`` of every line of the text files below a folder.

    A file may be read in several blocks at once; the place of a block and of a line in it give the order.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), "value")
    return row_numbers(lines, [F.col("_block"), F.col("_row")], ["file"], rank="line_no").select("file", "line_no", "value")


def discover_media(
    spark: SparkSession, roots: Sequence[str], suffixes: Sequence[str] = MEDIA_SUFFIXES, recursive: bool = True
) -> DataFrame:
    """Media files below the roots; a file that several roots reach belongs to the first of them."""
    pattern = "(?i)\\.(" + "|".join(suffixes) + ")$"
    found = None
    for position, root in enumerate(roots):
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
            .select("path", "length").where(F.col("path").rlike(pattern))
            .withColumn("root_no", F.lit(position)).withColumn("root", F.lit(root)))
        found = files if found is None else found.unionByName(files)
    return found.groupBy("path").agg(F.min("root_no").alias("root_no"), F.min_by("root", "root_no").alias("root"), F.first("length").alias("length"))


def write_report_csv(rows: DataFrame, path: str, fields: Sequence[str]) -> None:
    """CSV with a header and a fixed column order; missing columns and values become empty."""
    columns = [F.col(f) if f in rows.columns else F.lit("").alias(f) for f in fields]
    rows.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_trials_csv(rows: DataFrame, path: str) -> None:
    write_report_csv(rows, path, TRIAL_FIELDS)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    write_report_csv(summary, path, SUMMARY_FIELDS)


def append_results_jsonl(metrics: DataFrame, path: str) -> None:
    """Append ``{epoch, metrics}`` lines; an epoch that is written again replaces its line."""
    append_epochs(metrics.select("epoch", "metrics"), path)


def manifest_lines(
    tokens: DataFrame, offsets: DataFrame, colors: DataFrame, stage: str, args: Mapping[str, str] | None = None,
    units: DataFrame | None = None,
) -> DataFrame:
    """Manifest as JSON lines, one section row each: totals, arguments, clusters with colour, videos with token range.

    ``units(video, layer, start_sec, end_sec)`` adds one line per time window of a layer.

    Kept as lines, so that a corpus of any number of videos never becomes one value.
    """
    totals = tokens.agg(
        F.count_distinct("video").alias("num_videos"), F.count(F.lit(1)).alias("num_tokens_total"),
        F.count_if(F.col("cluster") >= 0).alias("num_tokens_assigned"))
    head = totals.select(
        F.lit("totals").alias("section"), F.lit("").alias("key"),
        F.to_json(F.struct(F.lit(stage).alias("stage_name"), "num_videos", "num_tokens_total", "num_tokens_assigned")).alias("body"))
    counts = tokens.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))
    clusters = counts.join(colors.select("cluster", "hex"), "cluster").select(
        F.lit("cluster").alias("section"), F.col("cluster").cast("string").alias("key"),
        F.to_json(F.struct("count", "hex")).alias("body"))
    videos = offsets.select(
        F.lit("video").alias("section"), F.col("video").cast("string").alias("key"),
        F.to_json(F.struct("token_start", "token_end", "token_count")).alias("body"))
    lines = head.unionByName(clusters).unionByName(videos)
    if args:
        pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.to_json(F.struct(F.lit(v).alias("value"))).alias("body")) for k, v in args.items()]))
        listed = tokens.sparkSession.range(1).select(F.lit("argument").alias("section"), pairs)
        lines = lines.unionByName(listed)
    if units is not None:
        lines = lines.unionByName(units.select(
            F.lit("unit").alias("section"), F.concat_ws("/", "video", "layer").alias("key"),
            F.to_json(F.struct("start_sec", "end_sec")).alias("body")))
    return lines
