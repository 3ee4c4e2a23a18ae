"""Line dedup with two Bloom filters.

A first pass sends only 64-bit hashes of the lines to segments of the hash space. Each segment keeps a filter of what it has seen once
and one of what it has seen again. The second filters, whose size is bounded, go to all tasks; in the second pass only lines that they
hold are shuffled, with a 128-bit digest, to confirm the repeats exactly and to choose the document that keeps its lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from clipalign.session import materialize

from .text import SLICE, annotate, flat, raw_text

MIN_LENGTH = 40
MIN_DOCUMENTS = 5
#: Bits of a segment's filters, as a power of two. A segment gets the lines of 32 MB of text, at most one in 41 bytes: 10 bits each.
SEGMENT_BITS = 23
SEGMENT_BYTES = 32 << 20
#: Bytes of all twice-seen filters together. Beyond it they are folded: more lines are then suspected, and none is missed.
FILTER_BYTES = 64 << 20


def line_key(line: bytes) -> bytes | None:
    """The line without ASCII white space at both ends, with A-Z in lower case; None if it is too short to count."""
    key = line.strip().lower()
    if len(key) < MIN_LENGTH or len(key) < 4 * MIN_LENGTH and len(key.decode("utf-8", "replace")) < MIN_LENGTH:
        return None
    return key


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where a filter of 2**bits bits keeps each hash: four places from the two halves of a remixed hash."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    a, b = mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(4)]


class Pair:
    """The once-seen and the twice-seen filter of a segment."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(1 << bits, dtype=bool)
        self.twice = np.zeros(1 << bits, dtype=bool)

    def add(self, hashes: np.ndarray, again: np.ndarray) -> None:
        unique, where, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        repeated = (counts > 1) | (np.bincount(where, weights=again, minlength=len(unique)) > 0)
        at = places(unique, self.bits)
        repeated |= np.logical_and.reduce([self.once[p] for p in at])
        for p in at:
            self.twice[p[repeated]] = True
            self.once[p] = True

    def folded(self) -> tuple[int, bytes]:
        """The twice-seen filter, halved while it stays under an eighth full."""
        bits, kept = self.bits, self.twice
        while bits > 6 and np.count_nonzero(kept) * 16 < len(kept):
            kept = kept[:len(kept) // 2] | kept[len(kept) // 2:]
            bits -= 1
        return bits, np.packbits(kept, bitorder="little").tobytes()


def _hashes(batch: pa.RecordBatch) -> Iterator[list]:
    """(hash, seen in several rows) of the line keys of a batch."""
    found: dict[int, bool] = {}
    for at in range(0, batch.num_rows, SLICE):
        for raw in batch.slice(at, SLICE).column(0).to_pylist():
            for key in {k for line in (raw or b"").split(b"\n") if (k := line_key(line))}:
                h = xxhash.xxh3_64_intdigest(key)
                found[h] = h in found
    hashes = np.fromiter(found.keys(), dtype=np.uint64, count=len(found))
    yield [hashes.view(np.int64), np.fromiter(found.values(), dtype=bool, count=len(found))]


def twice_seen(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, filter_bytes: int = FILTER_BYTES) -> tuple[int, dict]:
    """(number of segments, segment -> (bits, twice-seen filter)). What reaches the driver is at most `filter_bytes`."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(1, -(-total // segment_bytes))

    hashes = flat(docs.select(raw_text()), "h bigint, again boolean", lambda: _hashes)
    dealt = (hashes.withColumn("segment", F.pmod(F.shiftright("h", 20), F.lit(segments)))
             .repartition(segments, "segment").sortWithinPartitions("segment"))

    def build(batches):
        pair, current = None, None
        done = []
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            again = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            segment = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(segment)) + 1), len(segment)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if current != segment[a]:
                    if pair:
                        done.append((current, *pair.folded()))
                        yield from _segment_rows(done)
                    pair, current = Pair(SEGMENT_BITS), segment[a]
                pair.add(h[a:b], again[a:b])
        if pair:
            done.append((current, *pair.folded()))
            yield from _segment_rows(done)

    filters = materialize(dealt.mapInArrow(build, "segment bigint, bits int, filter binary"))
    size = filters.agg(F.sum(F.length("filter"))).first()[0] or 0
    halvings = 0
    while size >> halvings > filter_bytes:
        halvings += 1
    if halvings:
        def fold(batches):
            for batch in batches:
                rows = []
                for s, bits, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    kept = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
                    for _ in range(halvings):
                        if bits > 3:
                            kept = kept[:len(kept) // 2] | kept[len(kept) // 2:]
                            bits -= 1
                    rows.append((s, bits, np.packbits(kept, bitorder="little").tobytes()))
                yield from _segment_rows(rows)

        filters = filters.mapInArrow(fold, "segment bigint, bits int, filter binary")
    return segments, {r.segment: (r.bits, bytes(r.filter)) for r in filters.toLocalIterator()}


def _segment_rows(rows: list) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
            names=["segment", "bits", "filter"])
        rows.clear()


class Suspects:
    """All twice-seen filters, for lookups of many hashes at once."""

    def __init__(self, segments: int, filters: dict):
        self.segments = segments
        self.start = np.zeros(segments, dtype=np.int64)
        self.mask = np.full(segments, -1, dtype=np.int64)
        parts, at = [], 0
        for s, (bits, raw) in filters.items():
            self.start[s], self.mask[s] = at, (1 << bits) - 1
            parts.append(np.frombuffer(raw, np.uint8))
            at += len(raw) * 8
        self.filter = np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        segment = (hashes.view(np.int64) >> 20) % self.segments
        found = self.mask[segment] >= 0
        start, mask = self.start[segment], self.mask[segment]
        for p in places(hashes, SEGMENT_BITS):
            at = np.where(found, start + (p & mask), 0)
            found &= (self.filter[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) if len(self.filter) else False
        return found


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def repeated_lines(docs: DataFrame, min_documents: int, segment_bytes: int, filter_bytes: int) -> DataFrame:
    """doc_id and the digests of those of its lines that it must lose."""
    suspects = docs.sparkSession.sparkContext.broadcast(Suspects(*twice_seen(docs, segment_bytes, filter_bytes)))

    def make():
        def rows(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, keys = [], []
                for doc_id, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = {k for line in (raw or b"").split(b"\n") if (k := line_key(line))}
                    ids += [doc_id] * len(own)
                    keys += own
                held = suspects.value.hold(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                chosen = np.flatnonzero(held).tolist()
                yield [[ids[i] for i in chosen], [digest(keys[i]) for i in chosen]]

        return rows

    found = materialize(flat(docs.select(F.col("doc_id").cast("bigint"), raw_text()), "doc_id bigint, key binary", make))
    # a table of its own, so that the join deals both sides anew and can split a line that very many documents hold
    common = materialize(found.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
                         .filter((F.col("n") >= min_documents) & F.col("keeper").isNotNull()).select("key", "keeper"))
    return (found.join(common, "key").filter(F.coalesce(F.col("doc_id") < F.col("keeper"), F.lit(True)))
            .groupBy("doc_id").agg(F.collect_set("key").alias("keys")))


def dedup_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, segment_bytes: int = SEGMENT_BYTES,
                filter_bytes: int = FILTER_BYTES, into: str = "lines") -> DataFrame:
    """Replace `text` by its kept lines and add struct `into`: n_lines and n_dropped.

    A key is a line stripped of ASCII white space, A-Z lower-cased. Keys of 40 code points or more that `min_documents` rows hold lose
    all their lines but those of the largest doc_id. Null and empty texts are one empty line. Every row counts as a document, so rows
    that repeat a doc_id count apart and share its fate; a null doc_id is smaller than any, and keys that only null ids hold stay.
    All other columns pass through.
    """
    lost = repeated_lines(docs, min_documents, segment_bytes, filter_bytes).select(F.col("doc_id").alias("__lost_id"), F.col("keys").alias("__keys"))
    names = [c for c in docs.columns if c != into]
    joined = docs.join(lost, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__lost_id")), "left")

    def make():
        def row(raw, keys):
            lines = (raw or b"").split(b"\n")
            if not keys:
                return raw or b"", len(lines), 0
            gone = set(keys)
            kept = [x for x in lines if not ((k := line_key(x)) and digest(k) in gone)]
            return b"\n".join(kept), len(lines), len(lines) - len(kept)

        return row

    fields = "text binary, n_lines bigint, n_dropped bigint"
    done = annotate(joined.select(*[F.col(f"`{c}`") for c in names], "__keys"), into, fields, [raw_text(), F.col("__keys")], make)
    text = F.col(f"`{into}`.text").cast("string")
    return done.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
                       F.struct(f"`{into}`.n_lines", f"`{into}`.n_dropped").alias(into))
