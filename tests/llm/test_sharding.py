import hashlib

import pytest

from clipalign.llm import sharding

from .conftest import prose


def brute(rows, limit):
    bits = [format(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), "060b") for i, _ in rows]
    sizes = [len((t or "").encode()) for _, t in rows]
    out = []
    for b in bits:
        for depth in range(61):
            own = [s for x, s in zip(bits, sizes) if x[:depth] == b[:depth]]
            if sum(own) <= limit or depth == 60:
                out.append((b[:depth], depth, sum(own), len(own)))
                break
    return out


@pytest.mark.parametrize("limit", [1 << 30, 20_000, 1500, 300])
def test_only_oversized_buckets_split(table, limit):
    rows = [(i, prose(i, i % 60)) for i in range(200)] + [(None, "x"), (500, None), (501, "")]
    placed = sharding.assign_shards(table(rows), limit).collect()
    assert sorted((str(r.doc_id), *r.shard) for r in placed) == sorted((str(i), *x) for (i, _), x in zip(rows, brute(rows, limit)))


def test_deep_splits_and_rows_that_cannot_be_parted(table, monkeypatch):
    monkeypatch.setattr(sharding, "ROUND_BITS", 4)
    rows = [(i, "0123456789") for i in range(300)] + [(7, "again " * 10)] * 3
    placed = sharding.assign_shards(table(rows), 40).collect()
    assert sorted((r.doc_id, *r.shard) for r in placed) == sorted((i, *x) for (i, _), x in zip(rows, brute(rows, 40)))
    assert {r.shard.depth for r in placed if r.doc_id == 7} == {60}


def test_written_shards(spark, table, tmp_path):
    sharding.write_shards(table([(i, prose(i, 50)) for i in range(60)]), 2000, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 60
    sizes = {}
    for r in back.collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + len(r.text)
    assert max(sizes.values()) <= 2000


def test_awkward_rows(awkward, table):
    placed = sharding.assign_shards(awkward, 1000)
    assert placed.count() == awkward.count() and set(placed.columns) == set(awkward.columns)
    assert sharding.assign_shards(table([]), 1000).count() == 0
