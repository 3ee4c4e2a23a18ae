"""Byte-level BPE by backtracking over longest matches, and decoding.

A sequence of tokens is the encoding of a word exactly if merging the bytes of any two neighbours gives these two again. So a word is
covered by the longest token at each place, a token that doesn't go with the one before it is replaced by its longest prefix that is a
token, and a place from which nothing goes on is left for good. Each place is left at most once, and whether two tokens go together is
remembered, so the work is linear in the bytes. Tokens are found by an Aho-Corasick automaton over Latin-1 letters, one for each byte.
"""

from __future__ import annotations

import base64
import functools
import gc
import math
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from .text import Memo, annotate_columns, exact_keys, stop_size, word_of
from .wordtable import WordTable, binary_array

#: Pairs of tokens that a worker remembers in each of two generations, words of a worker from which it has too many, frequent ones that it keeps
#: then, and bytes of text encoded at a time. They bound the memory of a worker, as new words never end. Ids don't depend on them.
REMEMBERED = 150_000
WORDS = 300_000
FREQUENT_WORDS = 150_000
TEXT_BYTES = 1 << 20
#: In front of the first word of a text; others have at most one line feed there.
HEAD = "\n\n"


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a line for each, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class BytePairs:
    """The words of a text by `pattern`, each encoded by merging the neighbours of lowest rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"there is no rank for {len(missing)} single bytes")
        self.ranks = ranks
        self.words = regex.compile(pattern)
        self.plain = pattern == public_tokenizers.PATTERN
        self.tokens = {i: t for t, i in ranks.items()}
        self.n = 1 + max(ranks.values())
        self.sizes = [len(self.tokens.get(i, b"")) for i in range(self.n)]
        # what the last merge of a token joins; None if that isn't of its own rank
        self.halves = {t: tuple(parts) if len(parts := self.merge(t, i)) == 2 else None for t, i in ranks.items() if len(t) > 1}
        # a token that merging doesn't make from its own bytes stands only for a whole word
        made = {t for t in ranks if len(t) == 1 or self.halves[t] or self.merge(t) == [t]}
        self.ordered = all(self.halves.values())
        self.automaton = ahocorasick.Automaton()
        for t in made:
            self.automaton.add_word(t.decode("latin-1"), ranks[t])
        self.automaton.make_automaton()
        self.shorter = [-1] * self.n
        for t in made:
            self.shorter[ranks[t]] = next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in made), -1)
        self.fits = Memo(self._fits, REMEMBERED)
        self.ends = [Memo(lambda t, side=side: self._ends(t, side), self.n) for side in (0, 1)]

    def merge(self, raw: bytes, below: float = math.inf) -> list[bytes]:
        """Merge the leftmost neighbours of lowest rank until none has a rank `below` that. Used on single tokens."""
        parts = [raw[i:i + 1] for i in range(len(raw))]
        ranks = [self.ranks.get(a + b, math.inf) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < below:
            i = ranks.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            for k in (i - 1, i):
                if 0 <= k < len(ranks):
                    ranks[k] = self.ranks.get(parts[k] + parts[k + 1], math.inf)
        return parts

    def _ends(self, token: bytes, side: int) -> list[tuple[bytes, int, float]]:
        """What lies at one side of a token while it is merged: the bytes, the rank at which they came to be, and that at which they go on."""
        if len(token) == 1:
            return [(token, -1, math.inf)]
        half, since, _ = self.ends[side][self.halves[token][side]][0]
        own = self.ranks[token]
        return [(token, own, math.inf), (half, since, own), *self.ends[side][half][1:]]

    def _fits(self, pair: int) -> bool:
        """Whether two tokens, left * n + right, can be neighbours: no merge over their border comes before those that make them."""
        left, right = (self.tokens[i] for i in divmod(pair, self.n))
        if not self.ordered:
            return self.merge(left + right) == [left, right]
        ranks = self.ranks
        for a, a_since, a_until in self.ends[1][left]:
            for b, b_since, b_until in self.ends[0][right]:
                # of equal ranks the leftmost merges first
                if a_since < b_until and b_since < a_until and a_until > (rank := ranks.get(a + b, math.inf)) <= b_until:
                    return False
        return True

    def encode_word(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None or not raw:
            return [whole] if raw else []
        letters = raw.decode("latin-1")
        sizes, shorter, fits, n, search = self.sizes, self.shorter, self.fits, self.n, self.automaton.iter_long
        # the longest token at each place where the longest before it ends; the other places follow when they are needed
        longest = {end + 1 - sizes[i]: i for end, i in search(letters)}
        dead: set[int] = set()
        found: list[int] = []
        at, last, token = 0, -1, longest[0]
        while True:
            end = at + sizes[token]
            if end not in dead and (last < 0 or fits[last * n + token]):
                found.append(token)
                if end == len(raw):
                    return found
                at, last = end, token
                token = longest.get(at, -1)
                if token < 0:
                    token = longest[at] = next(search(letters, at))[1]
                continue
            token = shorter[token]
            while token < 0:
                dead.add(at)
                token = found.pop()
                at -= sizes[token]
                token, last = shorter[token], found[-1] if found else -1

    def encode(self, text: str) -> list[int]:
        if text.isascii() and text.removeprefix(" ").isalpha() and self.plain:
            return self.encode_word(text.encode())
        return [i for word in self.words.findall(text) for i in self.encode_word(word.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextEncoder:
    """Encodes whole texts, remembering the ids of words.

    `PATTERN` of the public tokenizers ends a word wherever a space or line feed follows a character that is no white space, so the parts
    between such places are encoded alone. With any other pattern whole texts are encoded.
    """

    def __init__(self, pairs: BytePairs):
        self.pairs = pairs
        # letters end before a full stop or comma, which is then a word of its own
        self.words = WordTable(lambda words: [binary_array(list(map(self._word, words)))], lambda tails: [binary_array(list(map(self._ids, tails)))],
                               stop_size, WORDS, FREQUENT_WORDS, head=HEAD)

    def _ids(self, part: str) -> bytes:
        ids = self.pairs.encode(part)
        return struct.pack(f"<{len(ids)}i", *ids)

    def _word(self, word: str) -> bytes | None:
        """Ids of a word of the table; None for white space that the table can't tell apart."""
        if word == HEAD:
            return b""
        if not word or word[-1].isspace():
            return None
        return self._ids(word[len(HEAD):] if word.startswith(HEAD) else word if word[0] == "\n" else " " + word)

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        self.pairs.fits.trim()
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        out = [b""] * len(texts)
        rows = pc.indices_nonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False))
        if not self.pairs.plain:
            for row in rows.to_pylist():
                out[row] = self._ids(texts[row].as_py())
            return out
        found = self.words.find(texts.take(rows))
        for row, known, ids in zip(rows.to_pylist(), found.known.tolist(), found.joined()):
            out[row] = bytes(ids) if known else b"".join(self._ids(word_of(key)) for key in exact_keys(texts[row].as_py()))
        # what the words of a slice took would else stay with the worker
        found = ids = None
        pa.default_memory_pool().release_unused()
        return out


@functools.lru_cache(maxsize=1)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """The encoder of a Python worker, kept from task to task."""
    return TextEncoder(BytePairs(read_ranks(path), pattern))


def let_go() -> None:
    """Have a worker give back its encoder. A worker may encode in one task and decode in the next, and would keep both."""
    if text_encoder.cache_info().currsize:
        text_encoder.cache_clear()
        gc.collect()  # its parts refer to each other


def encode_texts(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, into: str = "encoded") -> DataFrame:
    """Add struct `into`: ids, the token ids of the whole text by the rank file at the path `ranks`.

    Null and empty texts have an empty list. Every row is kept, repeated ones too. A word in the vocabulary is one token; any other is
    merged by rank, and of equal neighbours the leftmost go first. An existing column `into` is replaced, all others pass through.
    """
    def make():
        token_bytes.cache_clear()

        def columns(each: list[bytes]) -> list:
            ends = np.cumsum([0, *map(len, each)], dtype=np.int64) // 4
            return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(each), dtype="<i4")))]

        return text_encoder(ranks, pattern).encode, columns

    return annotate_columns(docs, into, "ids array<int>", [F.col("text").cast("string")], make, text_bytes=TEXT_BYTES)


@functools.lru_cache(maxsize=1)
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: t for t, i in read_ranks(path).items()}


def decode_ids(encoded: DataFrame, ids, ranks: str, into: str = "decoded") -> DataFrame:
    """Add struct `into`: raw, the bytes that the ids in the column `ids` stand for. Null for null ids; an unknown id is refused."""
    def make():
        let_go()
        tokens = token_bytes(ranks).__getitem__

        def columns(lists: pa.Array) -> list:
            if lists.null_count:
                return [[None if x is None else b"".join(map(tokens, x)) for x in lists.to_pylist()]]
            # of this slice only; a list's ids as one run of Python integers
            values, ends = lists.flatten().to_numpy().tolist(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            return [[b"".join(map(tokens, values[a:b])) for a, b in zip(ends, ends[1:])]]

        return columns

    return annotate_columns(encoded, into, "raw binary", [ids], make)
