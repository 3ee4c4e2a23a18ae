"""Tar shards: finding them, indexing their members, grouping members into samples, and writing them."""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign.session import materialize

# Suffixes of shards, video members and pictures, and the order in which pictures are preferred.
SHARD_PATTERN = r"(?i)\.(tar|tar\.gz|tgz)$"
VIDEO_SUFFIXES = (".mp4", ".m4v", ".mov")
PICTURE_ORDER = ("jpg", "png", "jpeg", "webp")
SAMPLE_NAME = re.compile(r"^((?:.*/|)[^.]+)[.]([^/]*)$")
BRACE_RANGE = re.compile(r"\{(\d+)\.\.(\d+)\}")


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Path and length of the files below a folder or matching a glob; their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "length", "modificationTime")


def expand_braces(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths of one numeric brace range, padded to the wider bound."""
    first, last = BRACE_RANGE.search(pattern).groups()
    width = max(len(first), len(last))
    before, after = BRACE_RANGE.split(pattern)[0], BRACE_RANGE.split(pattern)[-1]
    number = F.lpad(F.col("id").cast("string"), width, "0")
    return spark.range(int(first), int(last) + 1).select(F.concat(F.lit(before), number, F.lit(after)).alias("wanted"))


def expand_weighted(spark: SparkSession, urls: str, weights: str) -> DataFrame:
    """Shards of a ``::`` list of brace patterns; every shard of a component has the component's weight."""
    components, shares = urls.split("::"), [float(w) for w in weights.split("::")]
    if len(components) != len(shares):
        raise ValueError(f"{len(components)} components but {len(shares)} weights")
    expanded = None
    for component, share in zip(components, shares):
        if BRACE_RANGE.search(component):
            part = expand_braces(spark, component).withColumnRenamed("wanted", "shard")
        else:
            part = spark.range(1).select(F.lit(component).alias("shard"))
        part = part.withColumn("weight", F.lit(share))
        expanded = part if expanded is None else expanded.unionByName(part)
    return expanded


def find_shards(spark: SparkSession, spec: str, recursive: bool = False) -> DataFrame:
    """Shards named by a comma list of folders, files, globs and brace ranges; each once, in path order."""
    found = None
    for piece in (p.strip() for p in spec.split(",")):
        if not piece:
            continue
        if BRACE_RANGE.search(piece):
            there = list_files(spark, posixpath.dirname(piece), recursive=False)
            wanted = expand_braces(spark, piece).select(F.regexp_extract("wanted", r"[^/]*$", 0).alias("_name"))
            part = there.withColumn("_name", F.regexp_extract("path", r"[^/]*$", 0)).join(wanted, "_name", "left_semi")
        else:
            part = list_files(spark, piece, recursive)
        part = part.select("path", "length")
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no shard location given")
    return found.where(F.col("path").rlike(SHARD_PATTERN)).distinct().orderBy("path")


def _open(path: str) -> io.BufferedIOBase:
    system, inner = fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:", "", path))
    return system.open_input_stream(inner, compression=None)


def _open_seekable(path: str) -> io.RawIOBase:
    system, inner = fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:", "", path))
    return system.open_input_file(inner)


def _members(path: str) -> Iterator[tuple[int, tarfile.TarInfo, tarfile.TarFile]]:
    """Members in order. Only the headers of a plain tar are read, and its contents skipped; a compressed one is read as a stream."""
    plain = path.lower().endswith(".tar")
    with (_open_seekable if plain else _open)(path) as raw, tarfile.open(fileobj=raw, mode="r:" if plain else "r|*") as tar:
        for position, member in enumerate(m for m in tar if m.isfile()):
            yield position, member, tar
            tar.members = []  # else the list of all members stays in memory


def _spread(shards: DataFrame) -> DataFrame:
    """One task per shard where there are few of them; a shard is read as one stream in any case."""
    return shards.select("path").repartition("path")


def index_members(shards: DataFrame) -> DataFrame:
    """One row per file in a shard, in shard order; ``is_video`` marks video members."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = []
                for position, member, _ in _members(path):
                    rows.append((path, position, member.name, member.size, member.name.lower().endswith(VIDEO_SUFFIXES)))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    columns = ["shard", "position", "member", "size", "is_video"]
    return _spread(shards).mapInPandas(read, "shard string, position long, member string, size long, is_video boolean")


def video_index(shards: DataFrame) -> DataFrame:
    """Video members with their sample id ``shard::member``, in shard and member order; none at all is an error."""
    # the index is small beside the shards, which are read once
    found = materialize(index_members(shards).where("is_video"))
    if found.isEmpty():
        raise ValueError("no video members in the shards")
    return found.withColumn("sample_id", F.concat_ws("::", "shard", "member")).drop("is_video").orderBy("shard", "position")


def group_samples(shards: DataFrame) -> DataFrame:
    """Consecutive members with one prefix form a sample; a repeated extension starts the next one.

    The rule needs the members in stream order, and a shard is one stream anyway, so one pass does both.
    Extensions are lowered. ``members`` maps extension to member name.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows: list[tuple] = []
                prefix, members, number = None, {}, 0
                for _, member, _ in _members(path):
                    named = SAMPLE_NAME.match(member.name)
                    if named is None:
                        continue
                    stem, extension = named.group(1), named.group(2).lower()
                    if prefix is not None and (stem != prefix or extension in members):
                        rows.append((path, number, prefix, members))
                        members, number = {}, number + 1
                    prefix = stem
                    members[extension] = member.name
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if members:
                    rows.append((path, number, prefix, members))
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    columns = ["shard", "sample_no", "key", "members"]
    schema = "shard string, sample_no long, key string, members map<string,string>"
    return _spread(shards).mapInPandas(read, schema)


def complete_samples(samples: DataFrame) -> DataFrame:
    """Samples with a caption and a picture; the picture is the first kind of the fixed order that is there."""
    pictures = [F.element_at("members", F.lit(kind)) for kind in PICTURE_ORDER]
    chosen = samples.where(F.map_contains_key("members", F.lit("txt"))).withColumn("image", F.coalesce(*pictures))
    return chosen.where("image is not null").withColumn("text", F.element_at("members", F.lit("txt")))


def write_shards(members: DataFrame, folder: str) -> DataFrame:
    """Write ``(shard, position, member, content)`` as tar files and return their paths and member counts.

    Rows arrive sorted within their task and are streamed to a file named after the attempt, which takes its place when it is
    whole. So a lost executor leaves no half shard, and two attempts at once don't meet in one file.
    """
    system, inner = fs.FileSystem.from_uri(folder if "://" in folder else re.sub(r"^file:", "", folder))
    system.create_dir(inner, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, _ = fs.FileSystem.from_uri(folder if "://" in folder else re.sub(r"^file:", "", folder))
        attempt = TaskContext.get().taskAttemptId()
        current, tar, out, count = None, None, None, 0
        done = []

        def close() -> None:
            tar.close()
            out.close()
            target.move(f"{inner}/_{current}.{attempt}", f"{inner}/{current}")
            done.append((f"{folder}/{current}", count))

        for batch in batches:
            for shard, name, content in zip(batch["shard"], batch["member"], batch["content"]):
                if shard != current:
                    if tar is not None:
                        close()
                    current, count = shard, 0
                    out = target.open_output_stream(f"{inner}/_{shard}.{attempt}")
                    tar = tarfile.open(fileobj=out, mode="w|")
                info = tarfile.TarInfo(name)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
                count += 1
        if tar is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "n_members"])

    ordered = members.repartition("shard").sortWithinPartitions("shard", "position")
    return ordered.select("shard", "member", "content").mapInPandas(write, "path string, n_members long")
