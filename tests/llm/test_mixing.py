import hashlib
import re

import pytest
from hypothesis import given, strategies as st

from clipalign.llm import mixing


@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 12), min_size=1, max_size=8))
def test_every_prefix_is_less_than_a_block_from_its_share(weights):
    placed = mixing.slots(weights)
    period = sum(weights.values())
    assert sorted(t for at in placed.values() for t in at) == list(range(period))
    for s, w in weights.items():
        for k, t in enumerate(placed[s]):
            assert k * period // w <= t < -(-(k + 1) * period // w)
        for t in range(period + 1):
            assert abs(sum(x < t for x in placed[s]) - t * w / period) < 1


def test_positions(table):
    weights, block = {"a": 4, "b": 2}, 8
    rows = [(i, "t", None, "a" if i % 3 else "b") for i in range(900)] + [(i, "t", None, ("c", None)[i % 2]) for i in range(900, 1000)]
    placed = mixing.mix(table(rows), weights, rest_weight=2, block=block).collect()
    group = {i: s if s in weights else mixing.REST for i, _, _, s in rows}
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:15]
    at = mixing.slots({"a": 2, "b": 1, mixing.REST: 1})
    for g in ("a", "b", mixing.REST):
        ordered = sorted((i for i in group if group[i] == g), key=digest)
        expected = {}
        for rank, i in enumerate(ordered):
            k = rank // block
            expected[i] = (k // len(at[g]) * 4 + at[g][k % len(at[g])]) * block + rank % block
        assert {r.doc_id: r.mix.position for r in placed if r.mix.source_group == g} == expected
    assert len({r.mix.position for r in placed}) == len(rows)
    assert all(r.mix.release <= r.mix.slot < r.mix.deadline for r in placed)


def test_ranks_over_many_slices(table, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    monkeypatch.setattr(mixing, "SUPER", 5)
    placed = mixing.mix(table([(i, "t", None, "a") for i in range(400)]), {"a": 1}, block=1)
    assert sorted(r.mix.block for r in placed.collect()) == list(range(400))


def test_mixed_order_keeps_every_row(table):
    docs = table([(i, "t", None, "ab"[i % 2]) for i in range(300)])
    assert sorted(mixing.in_mixed_order(docs, {"a": 3}, 1).collect()) == sorted(docs.collect())


def test_awkward_rows_and_weights(awkward, table):
    placed = mixing.mix(awkward, {"src0": 1})
    assert placed.count() == awkward.count() and set(placed.columns) == set(awkward.columns)
    assert placed.select("mix.position").distinct().count() == awkward.count()
    assert mixing.mix(table([]), {"a": 1}).count() == 0
    for weights in ({}, {"a": 0}, {"a": -1}):
        with pytest.raises(ValueError):
            mixing.slots(weights)


def test_no_python_in_the_plan(table):
    plan = mixing.mix(table([(1, "x", None, "a")]), {"a": 1})._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
