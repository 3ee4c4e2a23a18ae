"""SimHash near-dedup with BK-trees.

Distinct fingerprints go to shards by two of six blocks of their bits: two fingerprints that differ in four bits or fewer share at
least two blocks, so every link lies in some shard. Each shard is a BK-tree, whose children are keyed by their distance to the parent,
and a search follows only the edges within the radius. A shard returns a spanning forest instead of its links, and the components of
all forests are found by rounds of smallest labels.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from clipalign.session import materialize

from .text import annotate, raw_text, spaced_words

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Blocks of a fingerprint as (first bit, bits): radius + 2 of them, of which two are always equal.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Fingerprints of one shard; larger shards are searched in pairs of parts of that size.
SHARD = 20_000


def fingerprint(raw: bytes | None) -> int:
    """SimHash of the word shingles, repeats included; zero without words. Signed, as a long holds it."""
    words = spaced_words(raw)
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i:i + SHINGLE]), SEED) for i in range(n)), dtype="<u8", count=n)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):  # bounds the bits unpacked at a time
        part = hashes[at:at + 4096]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


class ShardTree:
    """A BK-tree that links each fingerprint to what it finds when it is added.

    A subtree of one component needs no search by a fingerprint that is already of that component. Which subtrees are of one component
    is brought up to date whenever the tree has doubled.
    """

    def __init__(self, radius: int = RADIUS):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.up: list[int] = []
        self.whole: list[bool] = []
        self.refresh_at = 64

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def _refresh(self) -> None:
        roots = [self.root(i) for i in range(len(self.up))]
        for i in range(len(self.up) - 1, -1, -1):  # children stand after their parent
            self.whole[i] = all(self.whole[c] and roots[c] == roots[i] for c in self.children[i].values())

    def add(self, value: int) -> None:
        n, r = len(self.values), self.radius
        self.values.append(value)
        self.children.append({})
        self.up.append(n)
        self.whole.append(True)
        if n == 0:
            return
        values, children, whole = self.values, self.children, self.whole
        stack = [0]
        while stack:
            i = stack.pop()
            if whole[i] and self.root(i) == self.root(n):
                continue
            d = (values[i] ^ value).bit_count()
            if d <= r and self.root(i) != self.root(n):
                self.up[self.root(n)] = self.root(i)
            stack += [c for e, c in children[i].items() if d - r <= e <= d + r]
        at = 0
        while True:
            whole[at] = whole[at] and self.root(at) == self.root(n)
            d = (values[at] ^ value).bit_count()
            nxt = children[at].get(d)
            if nxt is None:
                children[at][d] = n
                break
            at = nxt
        if len(self.values) >= self.refresh_at:
            self.refresh_at *= 2
            self._refresh()

    def forest(self):
        """(member, smallest member of its component), without the latter itself."""
        least: dict[int, int] = {}
        for i, v in enumerate(self.values):
            r = self.root(i)
            least[r] = min(least.get(r, v), v)
        return [(v, least[self.root(i)]) for i, v in enumerate(self.values) if v != least[self.root(i)]]


def shard_keys():
    """The shards of a fingerprint: the number of a pair of blocks, and the bits of both."""
    def block(i):
        first, bits = BLOCKS[i]
        return F.shiftrightunsigned("fp", first).bitwiseAND((1 << bits) - 1)

    pairs = list(combinations(range(len(BLOCKS)), 2))
    return F.explode(F.array(*[F.lit(n << 22).cast("bigint") + F.shiftleft(block(i), 11) + block(j) for n, (i, j) in enumerate(pairs)]))


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Spanning forests (a, b) of the links between the distinct fingerprints `fp`, one forest for each shard."""
    if radius + 2 != len(BLOCKS):
        raise ValueError("the blocks are laid out for a radius of 4")
    keyed = fps.select(F.col("fp"), shard_keys().alias("shard"))
    large = (keyed.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > shard)
             .select("shard", F.ceil(2 * F.col("n") / shard).alias("parts")))
    # a large shard is searched in pairs of parts; a fingerprint goes to all pairs that hold its part
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1),
                        lambda o: F.least(part, o) * F.col("parts") + F.greatest(part, o))
    dealt = (keyed.join(large, "shard", "left")
             .select("fp", "shard", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(pairs)).alias("pair")))
    dealt = dealt.repartition("shard", "pair").sortWithinPartitions("shard", "pair", "fp")

    def build(batches):
        held: list[np.ndarray] = []
        last = None
        out_a: list[int] = []
        out_b: list[int] = []

        def close():
            members = np.concatenate(held)
            held.clear()
            if len(members) < 2:
                return
            tree = ShardTree(radius)
            for v in members.tolist():
                tree.add(v)
            for a, b in tree.forest():
                out_a.append(a)
                out_b.append(b)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(np.array(out_a, dtype=np.uint64).view(np.int64)),
                                                pa.array(np.array(out_b, dtype=np.uint64).view(np.int64))], names=["a", "b"])
            out_a.clear()
            out_b.clear()
            return batch

        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            key, pair = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(pair) != 0)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(fp)]])
            first = (key[0], pair[0])
            if held and first != last:
                close()
            # a shard alone in the middle of a batch has no links
            for k in np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(fp))).tolist():
                held.append(fp[starts[k]:ends[k]])
                if ends[k] < len(fp):
                    close()
            last = (key[-1], pair[-1])
            if len(out_a) > 10_000:
                yield flush()
        if held:
            close()
        yield flush()

    return dealt.mapInArrow(build, "a bigint, b bigint").distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex of the edges (a, b): the smallest vertex of its component.

    Each round takes the smallest label around, follows that label's own, and is written to the shared folder.
    """
    both = materialize(edges.union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        around = (both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
                  .withColumnRenamed("a", "id"))
        lower = labels.join(around, "id").select("id", F.col("label").alias("old"), F.least("label", "low").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("jumped"))
        new = materialize(lower.join(jump, "low").select("id", "old", F.least("low", "jumped").alias("label")))
        moved = new.filter("old != label").limit(1).count()
        labels = new.select("id", "label")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id) of each row: the fingerprint and the smallest doc_id that links of 4 bits or fewer reach.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id each get a row. Null doc_ids get a row
    and the component's smallest other doc_id, or null without one.
    """
    hashed = annotate(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "fp", "fp bigint", [raw_text()],
                      lambda: lambda raw: (fingerprint(raw),))
    rows = materialize(hashed.select("doc_id", F.col("fp.fp").alias("fp")))
    least = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = _labelled(least, shard)
    components = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = joined.join(components, "label").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def _labelled(fps: DataFrame, shard: int) -> DataFrame:
    """The rows with `label`, the smallest fingerprint of the component; `fp` is distinct."""
    labels = component_labels(links(fps.select("fp"), shard=shard)).withColumnRenamed("id", "fp")
    return fps.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def keep_one(docs: DataFrame, shard: int = SHARD, null_ids: bool = False) -> DataFrame:
    """The row with the smallest doc_id of each component, with all its columns; of several such rows the smallest, by text first.

    Rows are told apart by doc_id and text, so clean texts that share a doc_id all stay. With `null_ids` rows without a doc_id take part
    and come after all others; else they all stay.
    """
    part = docs if null_ids else docs.filter(F.col("doc_id").isNotNull())
    doc_id = F.col("doc_id").cast("bigint")
    # texts of one key are equal and have one fingerprint
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(raw_text()), F.lit("")))
    hashed = annotate(part.select(doc_id.alias("doc_id"), key.alias("key"), "text"), "fp", "fp bigint", [raw_text()],
                      lambda: lambda raw: (fingerprint(raw),))
    rows = materialize(hashed.select("doc_id", "key", F.col("fp.fp").alias("fp")))
    labelled = _labelled(materialize(rows.select("fp").distinct()), shard)
    keyed = rows.join(labelled, "fp").groupBy("label", "doc_id", "key").count()
    first = keyed.groupBy("label").agg(F.min("doc_id").alias("first"))
    keyed = keyed.join(first, "label").filter(F.col("doc_id").eqNullSafe(F.col("first"))).select("label", "key")
    counted = keyed.groupBy("label").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    chosen = materialize(counted)
    winners = chosen.filter("n = 1").select(F.col("key").alias("__key"))
    several = chosen.filter("n > 1").select("label")
    with_key = part.withColumn("__key", key)
    if not several.isEmpty():
        # texts decide between the rows of one doc_id
        tied = keyed.join(several, "label").select(F.col("key").alias("__key"), "label")
        least = with_key.select("__key", "text").join(tied, "__key").groupBy("label").agg(F.min(F.struct("text", "__key")).alias("least"))
        winners = winners.union(materialize(least.select("least.__key")))
    others = sorted(docs.columns, key="text".__eq__, reverse=True)
    one = with_key.join(winners, "__key", "left_semi").groupBy("__key").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("row"))
    one = one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return one if null_ids else one.union(docs.filter(F.col("doc_id").isNull()))
