import pytest

from clipalign.llm import decontaminate as de
from clipalign.llm.text import plain_words

from .conftest import prose

LONG = " ".join(f"q{i}" for i in range(30))
ITEMS = [(10, LONG), (9, "short one"), (100, " ".join(f"q{i}" for i in range(5, 25))), (7, None), (8, "..."), (11, "a b a b a b a b a b a b a b a b"), (9, "short one"),
         (None, "no id item")]
TEXTS = [
    prose(1, 500), f"{prose(2, 100)} {LONG.upper()} {prose(3, 300)}", " ".join(f"q{i}" for i in range(3, 17)), " ".join(f"q{i}" for i in range(12)),
    "x Short, one! x short one " + prose(4, 10), "a b " * 20, None, "", "...", "no id item", f"{LONG} {LONG}", prose(5, 2000) + " short one",
]


def brute(text, items, window=13):
    words = plain_words((text or "").encode())
    hit, ids = set(), set()
    for item, body in items:
        own = plain_words((body or "").encode())
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at:at + size] == own[i:i + size]:
                    hit.update(range(at, at + size))
                    ids.add(item)
    ids.discard(None)
    return len(words), len(hit), sorted(map(str, ids)), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_bytes", [de.BLOCK_BYTES, 100])
def test_search_equals_brute_force(spark, table, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = de.find_contamination(table(list(enumerate(TEXTS))), items, block_bytes=block_bytes)
    rows = found.select("doc_id", "contamination.n_words", de.n_hit().alias("n_hit"), "contamination.item_ids", de.is_contaminated().alias("bad")).collect()
    for r in rows:
        assert (r.n_words, r.n_hit, r.item_ids, r.bad) == brute(TEXTS[r.doc_id], ITEMS)
    assert len(rows) == len(TEXTS)


def test_shift_passes_over_words_no_item_has():
    tables = de.build([("1", LONG.encode())])[0]
    assert tables.default == 11 and min(tables.shift.values()) == 0


def test_awkward_rows(spark, awkward, table):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = de.find_contamination(awkward, items)
    assert found.count() == awkward.count() and set(found.columns) == set(awkward.columns)
    assert de.find_contamination(table([]), items).count() == 0
    assert de.find_contamination(awkward, items.limit(0)).filter(de.is_contaminated()).count() == 0
