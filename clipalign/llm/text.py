"""Shared helpers: words of a text as UTF-8 bytes, and Python passes over whole rows in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .wordtable import by_size

#: Rows of an Arrow batch that are turned into Python objects at a time; bounds the memory of a worker, not the input.
SLICE = 256

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space.
_WORD_TABLE = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def plain_words(raw: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters from U+0080, with A-Z in lower case. Null has none."""
    return raw.translate(_WORD_TABLE).split() if raw else []


def spaced_words(raw: bytes | None) -> list[bytes]:
    """Runs between ASCII white space (space, U+0009 to U+000D), with A-Z in lower case. Null has none."""
    return raw.lower().split() if raw else []


def annotate(df: DataFrame, into: str, fields: str, inputs: list, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Add the struct column `into`, computed row by row in Python from `inputs`; a column of that name is replaced.

    `make` runs once per task and returns a function from the input values of a row to the values of `fields`. All other columns pass
    through as Arrow arrays without becoming Python objects.
    """
    names = [c for c in df.columns if c != into]
    struct = T._parse_datatype_string(f"struct<{fields}>")
    arrow = to_arrow_type(struct)
    n = len(inputs)
    packed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                       *[e.alias(f"i{i}") for i, e in enumerate(inputs)])
    out = T.StructType([*packed.schema.fields[:len(names)], T.StructField("out", struct)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                kept = batch.columns[:-n]
                values = [row(*x) for x in zip(*(c.to_pylist() for c in batch.columns[-n:]))]
                parts = [pa.array([v[i] for v in values], arrow.field(i).type) for i in range(arrow.num_fields)]
                made = pa.StructArray.from_arrays(parts, fields=list(arrow))
                yield pa.RecordBatch.from_arrays([*kept, made], names=[*batch.schema.names[:-n], "out"])

    done = packed.mapInArrow(run, out)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("out").alias(into))


def flat(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[list]]]) -> DataFrame:
    """Turn Arrow batches into other rows: `make` gives, once per task, a function from a batch to lists of column values."""
    out = T._parse_datatype_string(f"struct<{schema}>")
    arrow = to_arrow_type(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = make()
        for batch in batches:
            for columns in rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], names=[f.name for f in arrow])

    return df.mapInArrow(run, out)


def annotate_columns(df: DataFrame, into: str, fields: str, inputs: list, make: Callable[[], Callable[..., list]], rows: int = SLICE,
                     text_bytes: int | None = None) -> DataFrame:
    """As `annotate`, but `make` returns a function from the input arrays of up to `rows` rows to the arrays or lists of `fields`.

    With `text_bytes`, `make` returns two functions: from an input array of strings of about so many bytes to a list, and from up to `rows`
    items of that list to the arrays or lists of `fields`.
    """
    names = [c for c in df.columns if c != into]
    struct = T._parse_datatype_string(f"struct<{fields}>")
    arrow = to_arrow_type(struct)
    n = len(inputs)
    packed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                       *[e.alias(f"i{i}") for i, e in enumerate(inputs)])
    out = T.StructType([*packed.schema.fields[:len(names)], T.StructField("out", struct)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, columns = make() if text_bytes else (None, make())
        for given in batches:
            for whole in by_size(given, -1, text_bytes) if work else [given]:
                worked = work(whole.columns[-1]) if work else []
                for at in range(0, whole.num_rows, rows):
                    batch = whole.slice(at, rows)
                    found = columns(worked[at:at + rows]) if work else columns(*batch.columns[-n:])
                    parts = [pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(found, arrow)]
                    made = pa.StructArray.from_arrays(parts, fields=list(arrow))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-n], made], names=[*batch.schema.names[:-n], "out"])

    done = packed.mapInArrow(run, out)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("out").alias(into))


class Memo(dict):
    """Values by key, made when first asked for. `trim` forgets those that weren't asked for since about the last `limit` new ones."""

    def __init__(self, make: Callable[[Hashable], object], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self[key] = self.old[key] if key in self.old else self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


#: Before a space or line feed that follows a character that is no white space.
_WORD_START = re.compile(r"(?<=\S)(?=[ \n])")


def word_keys(text: str) -> list[str]:
    """Keys of the words of a text, cut before each space or line feed; `word_of` gives None for one if the text needs `exact_keys`."""
    keys = text.replace("\n", " \n").split(" ")
    if keys[0]:
        keys[0] = " " + keys[0]
        return keys
    return keys[1:]


def exact_keys(text: str) -> list[str]:
    """Keys of the parts of any text, cut before each space or line feed that follows a character that is no white space."""
    return [" " + part for part in _WORD_START.split(text)] if text else []


def word_of(key: str) -> str | None:
    """The part of the text that a key stands for, or None if it can't be told from its neighbours."""
    if key[:1] == " ":
        return key[1:]
    if not key or key[-1].isspace():
        return None
    return key if key[0] == "\n" else " " + key


def stop_size(word: str) -> int:
    """1 for a word that ends in a letter and a comma or full stop: byte-pair and piece tokenizers end a token between these."""
    return int(word[-1:] in (",", ".") and "@" < word[-2:-1] < "{" and word[-2].isalpha())


def raw_text(column: str = "text"):
    return F.col(column).cast("binary")
