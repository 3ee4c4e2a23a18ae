import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int, words: int = 400) -> str:
    """`n` made-up words in lines of a dozen, from a vocabulary of `words`."""
    draw = random.Random(seed)
    listed = [f"w{draw.randrange(words)}" for _ in range(n)]
    return "\n".join(" ".join(listed[i:i + 12]) + "." for i in range(0, n, 12))


@pytest.fixture
def table(spark):
    def make(rows):
        """Rows of (doc_id, text) or (doc_id, text, lang, source) as a table like `documents`."""
        full = [(*r, *(None, None)[:4 - len(r)], len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def awkward(table):
    """Nulls in any column, empty and white-space texts, a very long one, repeated rows, and columns that clash with the operators' own."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, prose(4, 30_000)), (5, "Word."), (5, "Word."), (None, "no id here, but text."), (None, None),
            (7, "éè 中文   x", None, None), (8, prose(8, 60), "en", "src0")]
    docs = table(rows)
    for name in ("n_words", "out", "c0", "i0", "fp", "shard", "keys", "lines", "license", "tokens", "mix", "quality", "language", "contamination"):
        docs = docs.withColumn(name, docs.n_chars)
    return docs
