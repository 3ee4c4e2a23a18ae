"""Benchmark decontamination by Wu-Manber search over words.

The test strings are windows of `window` consecutive item words, and whole items that are shorter. A shift table says how far the
search may jump after seeing a block of words; where it may not jump, the bucket of that suffix block names the test strings, and
direct comparison confirms.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from clipalign.session import materialize

from .text import annotate, plain_words, raw_text

WINDOW = 13
#: Bytes of benchmark text that one pass broadcasts at most; a larger benchmark takes several passes.
BLOCK_BYTES = 2 << 20


class Tables:
    """Shift and suffix tables of test strings of one length in words."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(3, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = {}

    def add(self, words: tuple[bytes, ...], item: str) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = words[end - b:end]
            self.shift[key] = min(self.shift.get(key, self.default), m - end)
        self.bucket.setdefault(words[m - b:], {}).setdefault(words, set()).add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(end, items) of every occurrence."""
        m, b, shift, default, n = self.length, self.block, self.shift.get, self.default, len(words)
        at = m
        while at <= n:
            step = shift(tuple(words[at - b:at]), default)
            if step:
                at += step
                continue
            found = self.bucket[tuple(words[at - b:at])].get(tuple(words[at - m:at]))
            if found:
                yield at, found
            at += 1


def build(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> list[Tables]:
    by_length: dict[int, Tables] = {}
    for item, raw in items:
        words = tuple(plain_words(raw))
        size = min(window, len(words))
        if size:
            tables = by_length.setdefault(size, Tables(size))
            for i in range(len(words) - size + 1):
                tables.add(words[i:i + size], item)
    return list(by_length.values())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """Items in blocks of about `block_bytes`; only one block is at the driver at a time, and a longer item is a block of its own."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item"), raw_text().alias("raw")).toLocalIterator():
        raw = bytes(r.raw) if r.raw is not None else None
        block.append((r.item, raw))
        size += len(raw or b"")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                       into: str = "contamination") -> DataFrame:
    """Add struct `into`: n_words, spans (start, end) of words inside an occurrence, merged, and the item ids found.

    Null and empty texts, of documents or items, have no words and never match. A null item_id is left out of the ids. Repeated rows
    give equal results each, repeated items one id. Without items nothing is found. All other columns pass through.
    """
    fields = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, item_ids array<string>"
    sc = docs.sparkSession.sparkContext
    done = None
    for block in benchmark_blocks(benchmark, block_bytes):
        tables = sc.broadcast(build(block, window))
        first = done is None
        # a table between two passes, so that one pass and its tables are in memory at a time
        source = docs if first else materialize(done)
        before = F.lit(None).cast(f"struct<{fields}>") if first else F.col(f"`{into}`")

        def make(tables=tables):
            def row(raw, earlier):
                words = plain_words(raw)
                spans = [(s["start"], s["end"]) for s in earlier["spans"]] if earlier else []
                items = set(earlier["item_ids"]) if earlier else set()
                for t in tables.value:
                    for end, found in t.search(words):
                        spans.append((end - t.length, end))
                        items |= found
                items.discard(None)
                return len(words), [{"start": a, "end": b} for a, b in merged(spans)], sorted(items)

            return row

        done = annotate(source, into, fields, [raw_text(), before], make)
    if done is None:
        done = annotate(docs, into, fields, [raw_text()], lambda: lambda raw: (len(plain_words(raw)), [], []))
    return done


def n_hit(into: str = "contamination"):
    return F.aggregate(F.col(f"{into}.spans"), F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["start"])


def is_contaminated(into: str = "contamination"):
    """Some word is hit, and at least a twentieth of all."""
    return (n_hit(into) > 0) & (20 * n_hit(into) >= F.col(f"{into}.n_words"))
