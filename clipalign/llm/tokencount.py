"""Token counts by a linear longest-match automaton.

Each word is read once, byte by byte, through the trie of the vocabulary. Where no edge goes on, the failure link of the node names
the node for what is left, and its count says how many tokens were passed on the way; so the greedy longest-match count comes out
without building a piece or looking back.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from .text import annotate, raw_text

#: Distinct words whose counts a task remembers; the memory is emptied at that size, and counts don't depend on it.
REMEMBERED = 400_000


def byte_letters() -> dict[str, int]:
    """The characters that a byte-level vocabulary writes for the 256 bytes: itself if printable, else the next free from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> set[bytes]:
    """The pieces of a byte-level vocabulary file as bytes; a leading space marks the start of a word."""
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    special = {t["content"] for t in described.get("added_tokens", ())}
    letters = byte_letters()
    return {bytes(letters[c] for c in piece) for piece in described["model"]["vocab"] if piece not in special}


class Automaton:
    """edges[v]: byte -> node; fail[v]: node after the longest piece at the front of v's string is taken off, and again if need be,
    until what is left is in the trie; popped[v]: how many pieces that took. A node that is a piece fails to the root with one."""

    def __init__(self, vocabulary: set[bytes]):
        missing = [b for b in range(256) if bytes([b]) not in vocabulary]
        if missing:
            raise ValueError(f"the vocabulary has no piece for {len(missing)} single bytes")
        self.edges: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in vocabulary:
            v = 0
            for byte in piece:
                nxt = self.edges[v].get(byte)
                if nxt is None:
                    nxt = self.edges[v][byte] = len(self.edges)
                    self.edges.append({})
                    is_piece.append(False)
                v = nxt
            is_piece[v] = bool(piece)
        self.fail = [0] * len(self.edges)
        self.popped = [0] * len(self.edges)
        level = [0]
        while level:
            below = []
            for v in level:
                for byte, child in self.edges[v].items():
                    below.append(child)
                    if is_piece[child]:
                        self.popped[child] = 1
                        continue
                    # the pieces of v come first; what is left of v takes the byte, or gives up pieces of its own
                    at, count = self.fail[v], self.popped[v]
                    while byte not in self.edges[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    self.fail[child], self.popped[child] = self.edges[at][byte], count
            level = below

    def count(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        v = n = 0
        for byte in word:
            nxt = edges[v].get(byte)
            while nxt is None:
                n += popped[v]
                v = fail[v]
                nxt = edges[v].get(byte)
            v = nxt
        while v:
            n += popped[v]
            v = fail[v]
        return n


class Counts(dict):
    """Counts of words, found when first asked for."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.automaton.count(b" " + word)
        return n


def count_tokens(docs: DataFrame, vocabulary: set[bytes], into: str = "tokens") -> DataFrame:
    """Add struct `into`: n_words (between ASCII white space) and n_tokens, each word matched greedily with a leading space.

    Null and empty texts, and texts of white space only, have no words and no tokens. Repeated rows give equal results each; all other
    columns pass through. The vocabulary must hold every single byte, so every word has a count. Its size bounds the broadcast.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary))

    def make():
        counts = Counts(automaton.value)

        def row(raw):
            words = raw.split() if raw else []
            if len(counts) > REMEMBERED:
                counts.clear()
            return len(words), sum(map(counts.__getitem__, words))

        return row

    return annotate(docs, into, "n_words bigint, n_tokens bigint", [raw_text()], make)
