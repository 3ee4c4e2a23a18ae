import re
from collections import Counter

import pytest

from clipalign.llm import quality

from .conftest import prose


def base(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    repeated = {p for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


TEXTS = [prose(1, 300), None, "", " \n ", "a b c d e", "a b c d e a b c d e", "x " * 50, "x y z " * 40 + prose(2, 500), "one two three four five six " * 3 + "end",
         "#$% <a> | b & c * d " * 4, "Line one is here.\nLine one is here.\n\nLine one is here. \n", prose(3, 20_000), "é 中文  x " * 5,
         prose(4, 100) + "\n" + prose(4, 100)]


def test_base_columns_equal_brute_force(table):
    rows = quality.judge(table(list(enumerate(TEXTS)))).collect()
    for r in rows:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == base(TEXTS[r.doc_id]), r.doc_id
        assert not (q.kept and q.base_failed)
    assert len(rows) == len(TEXTS)


GOOD = "The first sentence of this text has quite enough words to stand alone."


@pytest.mark.parametrize("line, fails", [
    (GOOD, False), ("Home | About | News | Contact", True), ("of%%% the&&& and### to$$$ words*** here%%% now&&& that###", True),
    ("THE WHOLE LINE IS WRITTEN IN CAPITAL LETTERS!!", True), ("word " * 30 + ".", True), ("Click here for our privacy policy.", True),
    ("Short title without a stop", True), ("Is this short one a question?", False), (GOOD[:-1] + " and it goes on without a stop", False),
])
def test_each_line_rule(table, line, fails):
    q = quality.judge(table([(1, f"{GOOD}\n{line}")])).first().quality
    assert q.n_failed_lines == int(fails) and q.clean_text == (GOOD if fails else f"{GOOD}\n{line}")


def test_documents_that_lose_too_much_are_rejected(table):
    menu = "Home | About | News | Contact | Imprint | Shop\n" * 4
    rows = quality.judge(table([(1, f"{menu}{GOOD}"), (2, f"{GOOD}\n{prose(5, 60)}\n{menu[:40]}")])).orderBy("doc_id").collect()
    assert [r.quality.kept for r in rows] == [False, True]


def test_awkward_rows(awkward, table):
    found = quality.judge(awkward)
    assert found.count() == awkward.count() and set(found.columns) == set(awkward.columns)
    assert found.filter("text is null and quality.kept").count() == 0
    assert quality.judge(table([])).count() == 0


def test_no_python_in_the_plan(table):
    plan = quality.judge(table([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
