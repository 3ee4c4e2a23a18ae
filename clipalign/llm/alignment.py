"""Alignment of two tokenizers over the same texts.

Both token sequences cut the bytes of a text at the ends of their tokens. The offsets that both lists of ends hold come from a galloping
intersection: each end of the shorter list is sought in the longer one by doubling steps from the last place and then by halving. They
cut both sequences into groups, and the differences of their ranks say which tokens of the one overlap which of the other. Tokens of a
group are linked. Links are counted over the corpus by pairs of ids, in how many documents a pair is linked.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import math
import os
import re
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from tokenizers import Tokenizer

from clipalign.session import materialize, scratch_path

from .text import SLICE, Memo, annotate_columns, exact_keys, stop_size, word_of
from .tokencount import byte_letters
from .wordtable import WordTable, binary_array

#: Words of a task from which it has too many, frequent ones that it keeps then, words worked out at a time, bytes of text aligned at a time,
#: and rows handed on at a time. Results don't depend on these bounds.
WORDS = 300_000
FREQUENT_WORDS = 150_000
BATCH = 2000
TEXT_BYTES = 1 << 20
ROWS = 64
#: Links that are spread out at a time, and pairs whose counts a task keeps before it hands them on.
LINKS = 250_000
PAIRS = 250_000
#: Bytes of a row group of aligned rows.
ROW_GROUP_BYTES = 16 << 20
#: Bytes of an Arrow batch, and rows of a batch of the Parquet reader, while pairs are made of aligned rows.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.parquet.columnarReaderBatchSize": "256"}
#: Pairs whose counts are broadcast, at most: fewer pairs than that are linked in more than 1 / FREQUENT of all documents' pairs.
FREQUENT = 1 << 20
#: Ids below 2 ** ID_BITS.
ID_BITS = 26
_OTHER = (1 << ID_BITS) - 1


def _gallop(longer: list[int], shorter: list[int]) -> tuple[list[int], list[int]]:
    """The places in both of the numbers that two rising lists share."""
    in_longer, in_shorter, low, n = [], [], 0, len(longer)
    longer = [*longer, math.inf]
    for place, x in enumerate(shorter):
        if longer[low] < x:
            low += 1
            if longer[low] < x:
                step = 1  # longer[low + step] >= x after this, or there is no such place
                while low + step < n and longer[low + step] < x:
                    step *= 2
                low = bisect_left(longer, x, low + step // 2 + 1, min(low + step, n))
        if longer[low] == x:
            in_longer.append(low)
            in_shorter.append(place)
    return in_longer, in_shorter


def gallop(longer: list[int], shorter: list[int]) -> list[tuple[int, int]]:
    """The places (in longer, in shorter) of the numbers that two rising lists share."""
    return list(zip(*_gallop(longer, shorter)))


def shared_ends(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """The places among the ends of a, and among those of b, of each offset at which tokens of both end."""
    if len(a_ends) < len(b_ends):
        at_b, at_a = _gallop(b_ends, a_ends)
        return at_a, at_b
    return _gallop(a_ends, b_ends)


@dataclass(frozen=True)
class Side:
    """One tokenizer: the ids of parts of a text, and the bytes that an id stands for."""

    ids: Callable[[list[str]], list[list[int]]]
    raw: Callable[[int], bytes]


def byte_level(path: str) -> Side:
    """A byte-level vocabulary of the tokenizers library; strings of its special tokens are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters = byte_letters()
    raw = Memo(lambda i: bytes(letters[c] for c in tokenizer.id_to_token(i)), 1 << 30)
    return Side(lambda parts: [e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)], raw.__getitem__)


def piece_level(path: str) -> Side:
    """A sentencepiece model that puts a space in front of a text and falls back to bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = list(map(model.id_to_piece, range(model.get_piece_size())))
    if any("▁" in p.lstrip("▁") or re.search("[A-Za-z][.,]", p) for p in pieces):
        raise ValueError("a piece of the model goes on after a word, so words can't be encoded alone")
    space = [model.piece_to_id("▁")]
    lead = len(model.encode("x"))

    def ids(parts: list[str]) -> list[list[int]]:
        # the model puts a space in front; what has none goes on after a letter, which is taken off again
        found = model.encode([p[1:] if p[:1] == " " else "x" + p for p in parts], num_threads=1)
        return [space if p == " " else x if p[:1] == " " else x[lead:] for p, x in zip(parts, found)]

    def raw(i: int) -> bytes:
        return bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()

    return Side(ids, Memo(raw, 1 << 30).__getitem__)


def align_ids(a: Side, b: Side, part: str, a_ids: list[int], b_ids: list[int]) -> tuple[bytes, bytes] | None:
    """The tokens of a part by groups, those of a before those of b, and the groups as text. None if the bytes of a side differ from the part's.

    A token is a 32-bit integer: its id, times four, two more if it is of b, and one more if it starts a group.
    """
    a_raw, b_raw, raw = list(map(a.raw, a_ids)), list(map(b.raw, b_ids)), part.encode()
    if b"".join(a_raw) != raw or b"".join(b_raw) != raw:
        return None
    cuts = shared_ends(list(accumulate(map(len, a_raw))), list(accumulate(map(len, b_raw))))
    tokens, shown, i, k = [], [], 0, 0
    for to_a, to_b in zip(*cuts):
        to_a, to_b = to_a + 1, to_b + 1
        own, other = a_ids[i:to_a], b_ids[k:to_b]
        tokens.append(own[0] * 4 + 1)
        tokens += [x * 4 for x in own[1:]]
        tokens += [x * 4 + 2 for x in other]
        shown.append(f"{','.join(map(str, own))}|{','.join(map(str, other))}")
        i, k = to_a, to_b
    return struct.pack(f"<{len(tokens)}i", *tokens), ";".join(shown).encode()


#: Parts that are aligned in one go: a space and a word of letters, digits and marks that neither tokenizer takes for white space.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u0131]+").fullmatch


def align_words(a: Side, b: Side, words: list[str]) -> list[tuple[bytes, bytes]] | None:
    """`align_ids` of a space and each of these words, from one sequence of tokens for all of them.

    Both tokenizers end a token before each space, so the words' tokens lie one after the other. None if the bytes of a side differ from
    those of the words, or if a word doesn't end where a token does.
    """
    raw = [b" " + w.encode() for w in words]
    text = b"".join(raw)
    ids, ends = [], []
    for side in (a, b):
        own = side.ids([text.decode()])[0]
        pieces = list(map(side.raw, own))
        if b"".join(pieces) != text:
            return None
        ids.append(np.array(own, np.int32))
        ends.append(list(accumulate(map(len, pieces))))
    at_ends = [np.array(x, np.int64) for x in shared_ends(*ends)]
    # the shared ends at which a word ends, and the tokens before them
    word_ends = np.cumsum([len(x) for x in raw])
    cut_ends = np.array(ends[0])[at_ends[0]]
    place = np.searchsorted(cut_ends, word_ends)
    if not np.array_equal(cut_ends[place], word_ends):
        return None
    to_a, to_b = (x + 1 for x in at_ends)
    from_a, from_b = np.append(0, to_a[:-1]), np.append(0, to_b[:-1])
    at_a = np.arange(len(ids[0])) + np.repeat(from_b, to_a - from_a)
    at_b = np.arange(len(ids[1])) + np.repeat(to_a, to_b - from_b)
    tokens = np.empty(len(at_a) + len(at_b), "<i4")
    tokens[at_a], tokens[at_b] = ids[0] * 4, ids[1] * 4 + 2
    tokens[from_a + from_b] |= 1
    marks = np.full(len(tokens), ",")
    marks[to_a + from_b - 1], marks[to_a + to_b - 1] = "|", ";"
    shown = [f"{i}{m}" for i, m in zip((tokens >> 2).tolist(), marks.tolist())]
    packed, stops = tokens.tobytes(), (to_a + to_b)[place].tolist()
    return [(packed[4 * s:4 * e], "".join(shown[s:e])[:-1].encode()) for s, e in zip([0, *stops[:-1]], stops)]


class Aligner:
    """Aligns whole texts, each distinct word about once: both tokenizers end a token where a space or line feed follows another character."""

    def __init__(self, a: Side, b: Side):
        self.sides = a, b
        self.words = WordTable(self._plain, self._values, stop_size, WORDS, FREQUENT_WORDS, parts=2)

    def _values(self, parts: list[str | None]) -> list[pa.Array]:
        """The tokens and the groups as text with a semicolon behind; both empty where a side changes bytes, and null for null."""
        a, b = self.sides
        own = [p for p in parts if p is not None]
        plain = [p for p in own if p[0] == " " and _PLAIN(p, 1)]
        made = dict(zip(plain, align_words(a, b, [p[1:] for p in plain]) or ())) if plain else {}
        other = [p for p in own if p not in made]
        made |= zip(other, [align_ids(a, b, *x) for x in zip(other, a.ids(other), b.ids(other))])
        values = [(None, None) if p is None else (made[p][0], made[p][1] + b";") if made[p] else (b"", b"") for p in parts]
        return [binary_array([v[i] for v in values]) for i in (0, 1)]

    def _plain(self, words: list[str]) -> list[pa.Array]:
        parts = list(map(word_of, words))
        return [pa.concat_arrays(x) for x in zip(*(self._values(parts[i:i + BATCH]) for i in range(0, len(parts), BATCH)))]

    def _exact(self, text: str) -> tuple[bytes, bytes]:
        """The tokens and groups of a text with white space that the table can't tell apart."""
        parts = list(map(word_of, exact_keys(" " + text)))
        distinct = list(dict.fromkeys(parts))
        keys = [p[1:] if p[0] == " " else p for p in distinct]
        held = [word_of(k) == p and " " not in k for p, k in zip(distinct, keys)]
        alone = [p for p, h in zip(distinct, held) if not h]
        places = self.words.places([k for k, h in zip(keys, held) if h])
        # words whose hash is that of another have none
        alone += [p for p, place in zip([p for p, h in zip(distinct, held) if h], places.tolist()) if not place]
        made = dict(zip([p for p, h in zip(distinct, held) if h], zip(*(x.to_pylist() for x in self.words.at(places)))))
        for i in range(0, len(alone), BATCH):
            made.update(zip(alone[i:i + BATCH], zip(*(x.to_pylist() for x in self._values(alone[i:i + BATCH])))))
        found = list(map(made.__getitem__, parts))
        return (b"".join([x for x, _ in found]), b"".join([x for _, x in found])) if all(x for x, _ in found) else (b"", b"")

    def align(self, texts: list[str | None] | pa.Array) -> list[tuple[bytes, str]]:
        """The tokens of a space and the text, and the SHA-256 of their groups as text; both are empty without tokens."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        out = [(b"", "")] * len(texts)
        rows = pc.indices_nonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False))
        found = self.words.find(texts.take(rows))
        for row, known, empty, tokens, shown in zip(rows.to_pylist(), found.known.tolist(), found.any_empty().tolist(), found.joined(0), found.joined(1)):
            if not known:
                tokens, shown = self._exact(texts[row].as_py())
            elif empty:
                continue
            if tokens:
                out[row] = bytes(tokens), hashlib.sha256(shown[:-1]).hexdigest()
        # what the words of a slice took would else stay with the worker
        found = tokens = shown = None
        tokens = shown = None
        pa.default_memory_pool().release_unused()
        return out


@functools.lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    """The aligner of a Python worker, kept from task to task."""
    return Aligner(byte_level(a), piece_level(b))


def let_go() -> None:
    """Have a worker give back its aligner, which the steps after the alignment don't need."""
    if aligner.cache_info().currsize:
        aligner.cache_clear()
        gc.collect()  # its parts refer to each other
        pa.default_memory_pool().release_unused()


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def _sides(tokens: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of a, ids of b, and numbers of tokens of both in each group, in turn, and how many of each are of each text, of `counts` tokens."""
    ends = np.append(0, np.cumsum(counts))
    per = lambda chosen: np.diff(np.append(0, np.cumsum(chosen))[ends])
    of_b, first = tokens & 2 > 0, tokens & 1 > 0
    starts = np.flatnonzero(first)
    n = np.diff(np.append(starts, len(tokens)))
    n_b = np.diff(np.append(np.append(0, np.cumsum(of_b))[starts], of_b.sum()))
    yield tokens[~of_b] >> 2, per(~of_b)
    yield tokens[of_b] >> 2, per(of_b)
    yield np.stack([n - n_b, n_b], axis=1).ravel(), 2 * per(first)


def unravel(each: list[bytes]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Ids of a, ids of b, and numbers of tokens of both in each group, in turn, as lists for the tokens of each text."""
    counts = np.array([len(x) // 4 for x in each], np.int64)
    a, b, sizes = (_lists(*x) for x in _sides(np.frombuffer(b"".join(each), dtype="<i4"), counts))
    return a, b, sizes


def _numbers(each: list[bytes]) -> list[pa.Array]:
    """How many tokens of a, tokens of b and groups each of these has."""
    ends = np.cumsum([0, *(len(x) // 4 for x in each)])
    tokens = np.frombuffer(b"".join(each), dtype="<i4")
    n_b, n_groups = (np.diff(np.append(0, np.cumsum(tokens & bit > 0))[ends]) for bit in (2, 1))
    return [pa.array(x) for x in (np.diff(ends) - n_b, n_b, n_groups)]


def align(docs: DataFrame, a: str, b: str, into: str = "alignment", packed: bool = False) -> DataFrame:
    """Add struct `into`: a and b, the token ids of a space and the whole text by the byte-level file `a` and the sentencepiece model `b`;
    sizes, the numbers of tokens of a and b in each group, in turn; groups_sha256, the digest of the groups as `a1,a2|b1;a3|b2,b3`.

    Null and empty texts, and those whose bytes a side doesn't give back, have empty lists and an empty digest. Every row is kept, repeated
    ones too. An existing column `into` is replaced, all others pass through. With `packed`, the struct has all tokens in one binary value,
    32-bit integers as by `align_ids`, and their numbers n_a, n_b and n_groups in place of the lists; `pair_counts` and `score_links` take both.
    """
    def make():
        def columns(aligned: list[tuple[bytes, str]]) -> list:
            tokens, digests = zip(*aligned)
            return [*([binary_array(tokens), *_numbers(tokens)] if packed else unravel(tokens)), list(digests)]

        return aligner(a, b).align, columns

    fields = "tokens binary, n_a bigint, n_b bigint, n_groups bigint" if packed else "a array<int>, b array<int>, sizes array<int>"
    return annotate_columns(docs, into, f"{fields}, groups_sha256 string", [F.col("text").cast("string")], make, ROWS, TEXT_BYTES)


def _spread(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs (a << ID_BITS | b) of the links of the groups, rising, and how many links each has, some groups at a time."""
    n_a, n_b = sizes[0::2].astype(np.int64), sizes[1::2].astype(np.int64)
    from_a, from_b, links = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    at, done = 0, np.concatenate([[0], np.cumsum(links)])
    while at < len(links):
        if links[at] > LINKS:  # a long group: the product of its distinct ids
            (x, x_n), (y, y_n) = (np.unique(ids[s:s + n].astype(np.int64), return_counts=True)
                                  for ids, s, n in ((a, from_a[at], n_a[at]), (b, from_b[at], n_b[at])))
            rows = max(1, LINKS // len(y))
            for i in range(0, len(x), rows):
                yield ((x[i:i + rows, None] << ID_BITS) | y).ravel(), (x_n[i:i + rows, None] * y_n).ravel()
            at += 1
            continue
        to = max(at + 1, int(np.searchsorted(done, done[at] + LINKS, "right")) - 1)
        # the k-th link of a group joins its token k // n_b of a with its token k % n_b of b
        group = np.repeat(np.arange(at, to), links[at:to])
        k = np.arange(len(group)) - (done[group] - done[at])
        x, y = a[from_a[group] + k // n_b[group]].astype(np.int64), b[from_b[group] + k % n_b[group]]
        yield np.unique((x << ID_BITS) | y, return_counts=True)
        at = to


def pairs_of(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct linked pairs of a document, rising, and how many links each has."""
    pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for more, n in _spread(a, b, sizes):
        if not len(pairs):
            pairs, counts = more, n.astype(np.int64, copy=False)
            continue
        pairs, place = np.unique(np.concatenate([pairs, more]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
    return pairs, counts


def _documents(batch: pa.RecordBatch, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`pairs_of` each row, from its packed tokens in the column `first`, or from its arrays a, b, sizes in the columns from there."""
    column = batch.columns[first]
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) // 4
        tokens = np.frombuffer(column.buffers()[2] or b"", "<i4")[ends[0]:ends[-1]]
        arrays = [(values, np.append(0, np.cumsum(counts))) for values, counts in _sides(tokens, np.diff(ends))]
    else:
        arrays = [(column.values.to_numpy(), column.offsets.to_numpy()) for column in batch.columns[first:first + 3]]
    for row in range(batch.num_rows):
        yield pairs_of(*(values[ends[row]:ends[row + 1]] for values, ends in arrays))


def _lists_of(aligned: DataFrame, column: str) -> list:
    if "tokens" in aligned.schema[column].dataType.names:
        return [F.coalesce(F.col(f"`{column}`.tokens"), F.lit(b"")).alias("i0")]
    return [F.coalesce(F.col(f"`{column}`.{x}"), F.array().cast("array<int>")).alias(f"i{i}") for i, x in enumerate(("a", "b", "sizes"))]


@contextmanager
def _narrow_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed inside reads and hands on small batches, as aligned rows are several times as wide as their texts."""
    before = {name: spark.conf.get(name) for name in _BATCHES}
    try:
        for name, value in _BATCHES.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def write_aligned(aligned: DataFrame, path: str) -> None:
    """Write aligned rows as Parquet, in row groups that a task can hold beside others."""
    with _narrow_batches(aligned.sparkSession):
        aligned.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)


def pair_counts(aligned: DataFrame, column: str = "alignment") -> DataFrame:
    """pair, a, b, n_docs (rows in which the ids are linked) and best (n_docs is the highest of its a) of every linked pair.

    Every row counts, repeated ones too. Counts of a task are summed in it before they are shuffled.
    """
    schema = T._parse_datatype_string("struct<pair bigint, n bigint>")

    def run(batches):
        let_go()
        parts, held = [], 0

        def summed():
            pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            return pairs, np.bincount(place, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64)

        for batch in batches:
            for pairs, _ in _documents(batch, 0):
                parts.append((pairs, np.ones(len(pairs), np.int64)))
                held += len(pairs)
                if held > 2 * PAIRS:
                    parts = [summed()]
                    held = len(parts[0][0])
                    if held > PAIRS:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, parts.pop())], names=schema.names)
                        held = 0
        if parts:
            yield pa.RecordBatch.from_arrays([*map(pa.array, summed())], names=schema.names)

    counted = aligned.select(*_lists_of(aligned, column)).mapInArrow(run, schema).groupBy("pair").agg(F.sum("n").alias("n_docs"))
    with _narrow_batches(aligned.sparkSession):
        counted = materialize(counted.select("pair", F.shiftright("pair", ID_BITS).alias("a"), F.col("pair").bitwiseAND(_OTHER).alias("b"), "n_docs"))
    highest = counted.groupBy("a").agg(F.max("n_docs").alias("highest"))
    return counted.join(highest, "a").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, key: str, column: str = "alignment") -> DataFrame:
    """n_links, n_best (links whose pair has the highest count of its a) and count_sum (of the counts over links) of each row, by its `key`.

    `key` names a column that tells the rows apart. Pairs that a row could hold in more than a FREQUENT-th of all its like are fewer than
    FREQUENT, so their counts are broadcast; each of the others stands in few rows, which meet its count in a join.
    """
    spark = aligned.sparkSession
    counts = materialize(counts)
    total = counts.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    often = total // FREQUENT
    # fewer than FREQUENT rows have n_docs > total // FREQUENT, as n_docs sums up to total
    known = counts.filter(F.col("n_docs") > often).select("pair", "n_docs", "best").toArrow()
    order = np.argsort(known.column(0).to_numpy())
    frequent = spark.sparkContext.broadcast((known.column(0).to_numpy()[order], known.column(1).to_numpy()[order],
                                             known.column(2).to_numpy()[order].astype(np.int64)))
    schema = T.StructType([T.StructField("key", aligned.schema[key].dataType), *T._parse_datatype_string(
        "struct<pair bigint, times bigint, n_links bigint, n_best bigint, count_sum bigint>").fields])

    def run(batches):
        let_go()
        pairs_known, docs_known, best_known = frequent.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                sums, rare, times, owner = [], [], [], []
                for row, (pairs, n) in enumerate(_documents(batch, 1)):
                    place = np.minimum(np.searchsorted(pairs_known, pairs), max(0, len(pairs_known) - 1))
                    hit = pairs_known[place] == pairs if len(pairs_known) else np.zeros(len(pairs), bool)
                    place, hits = place[hit], n[hit]
                    sums.append((int(n.sum()), int((hits * best_known[place]).sum()), int((hits * docs_known[place]).sum())))
                    rare.append(pairs[~hit])
                    times.append(n[~hit])
                    owner.append(np.full(len(rare[-1]), row))
                # a row with the sums over frequent pairs, and one for each rare pair
                rows = np.concatenate([np.arange(len(sums)), *owner])
                empty = pa.nulls(len(rows) - len(sums), pa.int64())
                keys = batch.column(0).take(pa.array(rows))
                first = [pa.nulls(len(sums), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays(
                    [keys, *(pa.concat_arrays([f, pa.array(np.concatenate(x))]) for f, x in zip(first, (rare, times))),
                     *(pa.concat_arrays([pa.array([s[i] for s in sums], pa.int64()), empty]) for i in range(3))], names=schema.names)

    # a written table: both kinds of rows are read from it, and the texts aren't gone through twice
    path = scratch_path(spark, "links")
    with _narrow_batches(spark):
        aligned.select(F.col(f"`{key}`"), *_lists_of(aligned, column)).mapInArrow(run, schema).write.parquet(path)
    found = spark.read.parquet(path)
    rest = (found.filter(F.col("pair").isNotNull()).select("key", "pair", "times")
            .join(counts.filter(F.col("n_docs") <= often).select("pair", "n_docs", "best"), "pair")
            .groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")))
    sums = (found.filter(F.col("pair").isNull()).select("key", "n_links", "n_best", "count_sum")
            .unionByName(rest.withColumn("n_links", F.lit(0).cast("bigint"))))
    return sums.groupBy(F.col("key").alias(key)).agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
