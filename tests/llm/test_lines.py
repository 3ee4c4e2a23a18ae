import re
from collections import defaultdict

import numpy as np
import pytest

from clipalign.llm import lines

from .conftest import prose


def brute(rows, least):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x))
    holders = defaultdict(set)
    for n, (doc_id, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].add(n)
    out = []
    for doc_id, text in rows:
        kept = []
        for x in (text or "").split("\n"):
            held = holders.get(key(x), ())
            keeper = max((rows[n][0] for n in held if rows[n][0] is not None), default=None)
            if not (len(held) >= least and keeper is not None and (doc_id is None or doc_id < keeper)):
                kept.append(x)
        out.append((doc_id, "\n".join(kept), len((text or "").split("\n"))))
    return out


COMMON = "This very common line stands in a great many documents"
EXACTLY_40 = "é" * 40
ROWS = [
    *[(i, f"{prose(i, 40)}\n  {COMMON if i % 2 else COMMON.upper()}\t\n{EXACTLY_40}\n{EXACTLY_40[:39]}") for i in range(12)],
    *[(100 + i, f"shared by only four documents, so it stays where it is\nown {i}") for i in range(4)],
    (50, f"{COMMON}\n{COMMON}\nx"), (51, COMMON), (52, None), (53, ""), (54, "\n\n"), (None, COMMON), (51, COMMON),
]


@pytest.mark.parametrize("segment_bytes, filter_bytes", [(lines.SEGMENT_BYTES, lines.FILTER_BYTES), (1000, 64)])
def test_dedup_equals_brute_force(table, segment_bytes, filter_bytes):
    done = lines.dedup_lines(table(ROWS), segment_bytes=segment_bytes, filter_bytes=filter_bytes)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.text, r.lines.n_lines) for r in done.collect()), key=key)
    assert got == sorted(brute(ROWS, lines.MIN_DOCUMENTS), key=key)


def test_filters_miss_no_repeat():
    draw = np.random.default_rng(1)
    hashes = draw.integers(0, 2**63, 20_000, dtype=np.uint64)
    pair = lines.Pair(lines.SEGMENT_BITS)
    pair.add(hashes[:15_000], np.zeros(15_000, bool))
    pair.add(np.concatenate([hashes[15_000:], hashes[:500]]), np.zeros(5_500, bool))
    held = lines.Suspects(1, {0: pair.folded()}).hold(hashes)
    assert held[:500].all() and held[500:].mean() < 0.01


def test_keys_only_null_ids_hold_stay(table):
    done = lines.dedup_lines(table([(None, COMMON)] * 6)).collect()
    assert [r.text for r in done] == [COMMON] * 6


def test_awkward_rows(awkward, table):
    done = lines.dedup_lines(awkward)
    assert done.count() == awkward.count() and set(done.columns) == set(awkward.columns)
    assert {(r.n_lines, r.n_dropped) for r in done.filter("text = ''").select("lines.*").collect()} == {(1, 0)}
    assert lines.dedup_lines(table([])).count() == 0
