"""A sink of JSON lines keyed by epoch: ``df.write.format("epoch_jsonl")``.

Each task writes an epoch's lines to a file of its own beside the others; the commit gives it the epoch's name, in place of what an
earlier write had there. So a repeated epoch leaves its lines once, a failed task or job leaves none, and readers see whole files only.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:", "", path))


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: where they lie, and where they belong."""

    files: list[tuple[str, str]]


class EpochWriter(DataSourceWriter):
    def __init__(self, path: str, key: str):
        self.path, self.key = path, key

    def write(self, iterator: Iterator[Row]) -> Written:
        """Rows of an epoch come one after the other. What was written goes again if a row can't be."""
        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        current, out = object(), None
        try:
            for row in iterator:
                epoch = row[self.key]
                if epoch != current:
                    if out is not None:
                        out.close()
                    name = "none" if epoch is None else f"{epoch:012d}"
                    # a name that readers leave out
                    files.append((f"{folder}/_{name}-{uuid.uuid4().hex}", f"{folder}/{self.key}-{name}.jsonl"))
                    current, out = epoch, system.open_output_stream(files[-1][0])
                out.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode() + b"\n")
            if out is not None:
                out.close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            self._remove([Written(files)])
            raise
        if len({target for _, target in files}) < len(files):
            self._remove([Written(files)])
            raise ValueError(f"rows of one {self.key} have to follow each other")
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        placed = [f for m in messages if m for f in m.files]
        targets = [target for _, target in placed]
        if len(set(targets)) < len(targets):
            self._remove(messages)
            raise ValueError(f"rows of one {self.key} have to be in one task")
        for source, target in placed:
            system.move(source, target)

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(messages)

    def _remove(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        for source, _ in (f for m in messages if m for f in m.files):
            if system.get_file_info(source).type != fs.FileType.NotFound:
                system.delete_file(source)


class EpochLines(DataSource):
    """Option ``key`` names the column that the files are keyed by, ``epoch`` unless given."""

    @classmethod
    def name(cls) -> str:
        return "epoch_jsonl"

    def writer(self, schema: StructType, overwrite: bool) -> EpochWriter:
        key = self.options.get("key", "epoch")
        if key not in schema.names:
            raise ValueError(f"there is no column {key}")
        return EpochWriter(self.options["path"].rstrip(posixpath.sep), key)


def append_epochs(rows: DataFrame, path: str, key: str = "epoch") -> None:
    """Write the rows of each epoch as its file below ``path``, in place of the file that an earlier write of it left."""
    rows.sparkSession.dataSource.register(EpochLines)
    rows.repartition(key).sortWithinPartitions(key).write.format("epoch_jsonl").mode("append").option("key", key).save(path)
