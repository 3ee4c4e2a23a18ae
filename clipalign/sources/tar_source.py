"""Tar shards as a data source: ``spark.read.format("tar_members")``, and the contents of chosen members by their place.

    spark.dataSource.register(tar_source.TarMembers)
    spark.read.format("tar_members").load("/shards").where("suffix = 'txt' and shard like '%/shard-00%'")

Shards are dealt to partitions by their sizes when the scan is planned. Filters on ``shard`` leave out whole shards before anything is
opened, and those on ``member`` and ``suffix`` leave out members before a row is made. A schema of fewer columns reads only these;
``content`` has to be asked for in one, as else the contents are skipped.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clipalign.sources.shards import SHARD_PATTERN, VIDEO_SUFFIXES, _members, _open_seekable

COLUMNS = "shard string, position bigint, member string, suffix string, size bigint, offset bigint, is_video boolean"
WITH_CONTENT = f"{COLUMNS}, content binary"
#: Bytes of shards that one partition reads, unless a single shard is larger: a shard is one stream.
PARTITION_BYTES = 256 << 20
BATCH_ROWS, BATCH_BYTES = 10_000, 32 << 20

_TESTS: dict[type[Filter], Callable[[Filter], Callable[[str], bool]]] = {
    EqualTo: lambda f: lambda x: x == f.value,
    In: lambda f: lambda x, wanted=frozenset(f.value): x in wanted,
    StringStartsWith: lambda f: lambda x: x.startswith(f.value),
    StringEndsWith: lambda f: lambda x: x.endswith(f.value),
    StringContains: lambda f: lambda x: f.value in x,
}


def suffix_of(member: str) -> str:
    """What follows the last dot of a member's name, lowered; empty without a dot."""
    name = posixpath.basename(member)
    return name.rpartition(".")[2].lower() if "." in name else ""


def list_shards(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the shards in a folder, or of a file, or matching a pattern in the last part of the path, in order."""
    scheme, found = re.match(r"(?:([a-z][\w+.-]*):(?://[^/]*)?)?", path), []
    system, inner = fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:", "", path))
    folder, name = posixpath.split(inner)
    if any(c in name for c in "*?["):
        found = [f for f in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatchcase(f.base_name, name)]
    else:
        there = system.get_file_info(inner)
        if there.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [there] if there.is_file else system.get_file_info(fs.FileSelector(inner))
    before = scheme[0] if "://" in scheme[0] else ""
    return sorted((before + f.path, f.size) for f in found if f.is_file and re.search(SHARD_PATTERN, f.path))


class Shards(InputPartition):
    """The shards that one task reads, one after the other."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class TarReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int):
        self.path, self.schema, self.partition_bytes = path, schema, partition_bytes
        self.tests: dict[str, list[Filter]] = {"shard": [], "member": [], "suffix": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            if type(f) in _TESTS and column in self.tests:
                self.tests[column].append(f)
            elif not isinstance(f, IsNotNull):  # no column has nulls
                yield f

    def _test(self, column: str) -> Callable[[str], bool]:
        tests = [_TESTS[type(f)](f) for f in self.tests[column]]
        return lambda value: all(t(value) for t in tests)

    def partitions(self) -> list[Shards]:
        """Shards that the filters leave, the largest first, each to the partition that has least so far."""
        wanted = self._test("shard")
        shards = sorted(((size, path) for path, size in list_shards(self.path) if wanted(path)), reverse=True)
        n = max(1, -(-sum(size for size, _ in shards) // self.partition_bytes))
        dealt: list[list[str]] = [[] for _ in range(min(n, len(shards)) or 1)]
        load = [0] * len(dealt)
        for size, path in shards:
            least = load.index(min(load))
            dealt[least].append(path)
            load[least] += size + 512
        return [Shards(paths) for paths in dealt]

    def read(self, partition: Shards) -> Iterator[pa.RecordBatch]:
        arrow, names = to_arrow_schema(self.schema), self.schema.names
        member_fits, suffix_fits = self._test("member"), self._test("suffix")
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

        for path in partition.paths:
            for position, member, tar in _members(path):
                suffix = suffix_of(member.name)
                if not (suffix_fits(suffix) and member_fits(member.name)):
                    continue
                row = {"shard": path, "position": position, "member": member.name, "suffix": suffix, "size": member.size,
                       "offset": member.offset_data, "is_video": member.name.lower().endswith(VIDEO_SUFFIXES)}
                if "content" in names:
                    row["content"] = tar.extractfile(member).read()
                    held += member.size
                rows.append(tuple(row[n] for n in names))
                if len(rows) == BATCH_ROWS or held > BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class TarMembers(DataSource):
    """Members of the tar shards below ``path``, compressed ones too. Option ``partition_bytes`` bounds the shards of a partition."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(self.options["path"], schema, int(self.options.get("partition_bytes", PARTITION_BYTES)))


def read_members(spark: SparkSession, path: str, schema: str = COLUMNS, **options: str) -> DataFrame:
    """The members of the shards below ``path``, with filters pushed to the source. A bad shard fails the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarMembers)
    return spark.read.format("tar_members").schema(schema).options(**options).load(path)


def read_contents(chosen: DataFrame, into: str = "content") -> DataFrame:
    """Add the bytes of chosen members of plain shards, read by their ``shard``, ``offset`` and ``size``; nothing else of a shard is read.

    Members of a shard are read in the order of their places by one open file. A null in one of the three gives null.
    """
    names = [c for c in chosen.columns if c != into]
    packed = chosen.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                           F.struct("shard", "offset", "size").alias("at"))
    out = StructType([*packed.schema.fields[:-1]]).add(into, "binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, current = None, None
        try:
            for whole in batches:
                start, places = 0, whole.column(len(names)).to_pylist()
                while start < len(places):
                    contents, held = [], 0
                    for at in places[start:]:
                        if None in at.values():
                            contents.append(None)
                            continue
                        if at["shard"] != current:
                            if opened is not None:
                                opened.close()
                            current, opened = at["shard"], _open_seekable(at["shard"])
                        contents.append(opened.read_at(at["size"], at["offset"]))
                        held += at["size"]
                        if held > BATCH_BYTES:
                            break
                    part = whole.slice(start, len(contents))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(contents, pa.binary())], names=[*part.schema.names[:-1], into])
                    start += len(contents)
        finally:
            if opened is not None:
                opened.close()

    ordered = packed.repartition("at.shard").sortWithinPartitions("at.shard", "at.offset")
    done = ordered.mapInArrow(read, out)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], into)
