import random

import pytest
import xxhash
from pyspark.sql import functions as F

from clipalign.llm import simhash

from .conftest import prose


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for x, i in zip(label, ids):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return [least.get(x) for x in label]


@pytest.mark.parametrize("text", ["", " ", "one", "One two THREE", "a b c d", prose(1, 300), "x " * 100, "É é a B c"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def ball(seed, n, flips):
    draw = random.Random(seed)
    centre = draw.getrandbits(64)
    out = set()
    while len(out) < n:
        v = centre
        for _ in range(draw.randrange(flips + 1)):
            v ^= 1 << draw.randrange(64)
        out.add(v)
    return out


@pytest.mark.parametrize("shard", [simhash.SHARD, 16])
def test_components_of_chains_and_balls(spark, shard):
    draw = random.Random(5)
    values = {draw.getrandbits(64) for _ in range(100)} | ball(1, 120, 6) | ball(2, 40, 12)
    chain = draw.getrandbits(64)
    for i in range(0, 60, 4):
        chain ^= 0b1111 << i
        values.add(chain)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), shard=shard)
    labels = {r.id: r.label for r in simhash.component_labels(edges).collect()}
    expected = slow_components(list(range(len(values))), values)
    got = {}
    for i, v in enumerate(signed):
        got.setdefault(labels.get(v, v), []).append(i)
    assert sorted(got.values()) == sorted([i for i, x in enumerate(expected) if x == least] for least in set(expected))


def test_tree_prunes_whole_subtrees_without_losing_links():
    tree = simhash.ShardTree()
    values = [*ball(3, 400, 5), *ball(4, 400, 9)]
    random.Random(1).shuffle(values)
    for v in values:
        tree.add(v)
    roots = [tree.root(i) for i in range(len(values))]
    for i, a in enumerate(values):
        for j in range(i):
            assert (a ^ values[j]).bit_count() > 4 or roots[i] == roots[j]


def near(text, n):
    words = text.split(" ")
    return " ".join(f"changed{i}" if i < n else w for i, w in enumerate(words))


def test_documents_get_the_smallest_reachable_id(table):
    base = prose(7, 900)
    rows = [(i + 10, near(base, i % 3)) for i in range(30)] + [(5, base), (5, base), (1, prose(8, 50)), (None, base), (2, None), (3, ""), (4, "\n"), (None, prose(9, 40))]
    found = simhash.near_duplicates(table(rows))
    fps = [slow_fingerprint(t) for _, t in rows]
    expected = sorted(zip((r[0] for r in rows), fps, slow_components([r[0] for r in rows], fps)), key=str)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found.collect()), key=str) == expected
    kept = simhash.keep_one(table(rows))
    ids = sorted(r.doc_id for r in kept.filter(F.col("doc_id").isNotNull()).collect())
    assert ids == sorted({i for i, _, c in expected if i is not None and i == c})
    assert kept.filter(F.col("doc_id").isNull()).count() == 2


def test_rows_are_deduplicated_not_ids(table):
    base, other, lone = prose(7, 900), prose(11, 300), prose(12, 300)
    rows = [(1, base), (1, other), (2, near(base, 1)), (None, near(base, 2)), (None, other), (None, lone), (None, lone), (None, near(lone, 1)), (3, near(other, 1))]
    kept = simhash.keep_one(table(rows), null_ids=True).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, base), (1, other), (None, min(lone, near(lone, 1)))], key=str)
    named = [r for r in simhash.keep_one(table(rows)).collect() if r.doc_id is not None]
    assert sorted((r.doc_id, r.text) for r in named) == sorted([(1, base), (1, other)])


def test_awkward_rows(awkward, table):
    assert simhash.near_duplicates(awkward).count() == awkward.count()
    assert simhash.keep_one(awkward).columns == awkward.columns
    assert simhash.near_duplicates(table([])).count() == 0
