"""Token ids of whole texts in ORC files.

Files hold documents in order, one row each: the integer run-length encoding and the row indexes come with the format, and Bloom
filters on doc_id let a lookup skip stripes. `part` and `part_start` place a document among the tokens of its file, so a reader needs
only one small sum per file for the global offset, and stripes can be read in parallel.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T, Window as W
from tokenizers import Tokenizer

from .text import SLICE, flat
from .wordtable import WordTable, binary_array, by_size

END = 0
#: ASCII punctuation without the apostrophe: after a letter or digit, a run of it that ends a word is a piece of its own.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LONGEST_TAIL = 4
#: Words that the tokenizer gets as one text, frequent words that an encoder keeps once it has too many, and words from which it has too
#: many. Ids don't depend on these bounds.
AT_HAND = 512
COMMON = 200_000
REMEMBERED = 1_500_000
#: In front of the first word of a text; others have at most one line feed there.
HEAD = "\n\n"
ORC_OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
               "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20)}


class Remembered:
    """Ids of words by their 128-bit digests, in arrays that take a few dozen bytes a word."""

    def __init__(self):
        self.keys = np.empty((0, 2), dtype="<u8")
        self.first = np.empty(0, dtype="<u8")
        self.start = np.empty(0, dtype=np.int64)
        self.size = np.empty(0, dtype=np.uint32)
        self.ids = b""

    @staticmethod
    def _digests(words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in words]), dtype="<u8").reshape(-1, 2)

    def find(self, words: list[str]) -> list[bytes | None]:
        if not len(self.first):
            return [None] * len(words)
        keys = self._digests(words)
        at = np.minimum(np.searchsorted(self.first, keys[:, 0]), len(self.first) - 1)
        # equal first halves with unequal second ones would miss, and the word be encoded again
        held = (self.keys[at] == keys).all(axis=1).tolist()
        starts, sizes, ids = self.start[at].tolist(), self.size[at].tolist(), self.ids
        return [ids[a:a + n] if ok else None for ok, a, n in zip(held, starts, sizes)]

    def add(self, known: dict[str, bytes]) -> None:
        if len(self.first) + len(known) > REMEMBERED:
            self.__init__()
        values = list(known.values())
        sizes = np.array([len(v) for v in values], dtype=np.uint32)
        starts = len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes
        keys = np.concatenate([self.keys, self._digests(list(known))])
        order = np.argsort(keys[:, 0], kind="stable")
        self.keys, self.start = keys[order], np.concatenate([self.start, starts])[order]
        self.size, self.ids = np.concatenate([self.size, sizes])[order], self.ids + b"".join(values)
        self.first = np.ascontiguousarray(self.keys[:, 0])


def _tail_size(word: str) -> int:
    """How many characters of punctuation that is a piece of its own end a word."""
    body = word.rstrip(TAIL)
    if len(body) == len(word) or not ("\x00" < body[-1:] < "\u0250" and body[-1].isalnum()):
        return 0
    size = len(word) - len(body)
    return size if size <= LONGEST_TAIL else 0


class Encoder:
    """Encodes texts with a byte-level tokenizer, each distinct word about once.

    The tokenizer splits at a single space or line feed between characters that are no white space, and words to both sides of it don't
    change each other's ids. Texts with other white space are encoded whole. With `added_tokens` the tokenizer's added tokens get their
    own ids, as by the library on the file as loaded, and texts that hold one are encoded whole; else their strings are ordinary text.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        vocabulary = self.tokenizer.get_vocab()
        # a character of the vocabulary stands for a byte
        self.bytes = np.zeros(1 + max(vocabulary.values()), np.int64)
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        # punctuation that ends a word is a piece of its own, so the word before it is learned without it
        self.words = WordTable(self._plain, lambda tails: [binary_array(self._ids(tails))], _tail_size, REMEMBERED, COMMON, head=HEAD)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _in_one_go(self, words: list[str]) -> pa.Array:
        """Ids of words that each begin with a space or line feed and have no other white space."""
        sizes = pc.binary_length(pa.array(words, pa.string())).to_numpy().astype(np.int64)
        found = []
        for at in range(0, len(words), AT_HAND):
            part, ends = words[at:at + AT_HAND], np.cumsum(sizes[at:at + AT_HAND])
            ids = np.frombuffer(self._ids(["".join(part)])[0], dtype="<u4")
            stops = np.cumsum(self.bytes[ids])
            last = np.searchsorted(stops, ends)
            if stops[-1] != ends[-1] or not np.array_equal(stops[last], ends):
                found.append(binary_array(self._ids(part)))
                continue
            offsets = np.append(0, 4 * (last + 1)).astype(np.int32)
            found.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]))
        return pa.concat_arrays(found) if found else binary_array([])

    def _plain(self, words: list[str]) -> list[pa.Array]:
        """Ids of words after a space, with a line feed in front, or of a text's first word; null for what isn't one word."""
        starting = [w[:1] == "\n" for w in words]
        spaced = [i for i, x in enumerate(starting) if not x]
        own = [words[i] for i in spaced]
        other = []
        if " ".join(own).split() != own:
            other = [i for i in spaced if words[i].split() != [words[i]]]
            spaced = sorted(set(spaced).difference(other))
        lines, first = [], []
        for i in (i for i, x in enumerate(starting) if x):
            kind = first if words[i].startswith(HEAD) else lines
            body = words[i][len(HEAD) if kind is first else 1:]
            (kind if body.split() == [body] else other).append(i)
        found = [self._in_one_go([" " + words[i] for i in spaced]), self._in_one_go([words[i] for i in lines]),
                 binary_array(self._ids([words[i][len(HEAD):] for i in first])), binary_array([None] * len(other))]
        return [pa.concat_arrays(found).take(pa.array(np.argsort(np.array([*spaced, *lines, *first, *other], np.int64))))]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        out = [b""] * len(texts)
        filled = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        for token in self.added:
            holding = pc.and_(filled, pc.fill_null(pc.match_substring(texts, token), False))
            filled = pc.and_not(filled, holding)
            for row in pc.indices_nonzero(holding).to_pylist():
                out[row] = self._ids([texts[row].as_py()])[0]
        rows = pc.indices_nonzero(filled)
        found = self.words.find(texts.take(rows))
        for row, known, ids in zip(rows.to_pylist(), found.known.tolist(), found.joined()):
            # not of single words only
            out[row] = bytes(ids) if known else self._ids([texts[row].as_py()])[0]
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, kept from task to task."""
    return Encoder(path, added_tokens=True)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, order: list | None = None, end: int = END) -> None:
    """Write doc_id, part, part_start, n_tokens and ids of every row in ascending `order` (doc_id, null first, if none is given).

    Ids are the library's with the tokenizer as loaded. Null and empty texts have only the end id. Rows that repeat a doc_id follow each other by their text. Other columns aren't written.
    """
    keys = order or [F.col("doc_id").cast("bigint")]
    names = [f"o{i}" for i in range(len(keys))]
    rows = docs.select(*[k.alias(n) for k, n in zip(keys, names)], F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(*names).sortWithinPartitions(*names, "text").select("doc_id", "text")
    schema = T._parse_datatype_string("struct<doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>>")
    last = np.array([end], dtype="<u4").tobytes()

    def encoded(whole):
        """Some rows at a time with their ids; many are encoded at once."""
        for large in by_size(whole, 1):
            ids = encoder(tokenizer).encode(large.column(1))
            for at in range(0, large.num_rows, SLICE):
                yield large.slice(at, SLICE), [x + last for x in ids[at:at + SLICE]]

    def run(batches):
        start, part = 0, TaskContext.get().partitionId()
        for whole in batches:
            for batch, each in encoded(whole):
                sizes = np.array([len(x) // 4 for x in each], dtype=np.int64)
                ends = np.cumsum(sizes)
                ids = pa.array(np.frombuffer(b"".join(each), dtype="<u4").view(np.int32))
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(each), part, np.int32)), pa.array(start + ends - sizes), pa.array(sizes),
                     pa.ListArray.from_arrays(offsets, ids)], names=schema.names)
                start += int(ends[-1])

    ordered.mapInArrow(run, schema).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document, in the files' order), n_tokens and ids of every document."""
    rows = spark.read.orc(path)
    # one row per file, whatever the files hold, so it may be broadcast
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def find_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; the filter reaches the stripes' statistics and Bloom filters."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(doc_ids))


def with_crc(tokens: DataFrame, done: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.

    With `done`, workers let go of the words that they have encoded.
    """
    def make():
        if done:
            encoder.cache_clear()
            pa.default_memory_pool().release_unused()

        def rows(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists = part.column(3)
                values = lists.values.to_numpy().astype("<u4", copy=False)
                offsets = lists.offsets.to_numpy().tolist()
                yield [part.column(0), part.column(1), part.column(2),
                       [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]]

        return rows

    return flat(tokens.select("doc_id", "start", "n_tokens", "ids"), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", make)
