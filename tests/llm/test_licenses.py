from pyspark.sql import functions as F

from clipalign.llm import licenses
from clipalign.llm.text import plain_words


def brute(text, known):
    words = plain_words((text or "").encode())
    found = []
    for t in known:
        for start in range(-len(t.words), len(words)):
            if all(start + a >= 0 and tuple(words[start + a:start + b]) == t.words[a:b] for a, b in t.keys):
                found.append((start, t.label, t.base))
    return sorted(found)


def test_scan_equals_every_template_at_every_place(table):
    texts = [
        "CC BY and cc-by, then: CC\nBY. All rights reserved! all rights RESERVED", "GNU General Public License, version 3 and gnu general public license version 2",
        "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License. cc by sa", "license version 2 0",
        "general public", "by cc by cc by", "Licensed under the Apache License, Version 2.0.", None, "", "all rights reserved " * 300,
    ]
    docs = table(list(enumerate(texts)))
    known = licenses.templates()
    rows = {r.doc_id: r.license for r in licenses.scan_licenses(docs).collect()}
    for i, text in enumerate(texts):
        expected = brute(text, known)
        assert sorted((p.start, p.label, p.base) for p in rows[i].places) == expected
        assert rows[i].labels == sorted({x[1] for x in expected})
        assert rows[i].base_labels == sorted({x[1] for x in expected if x[2]})
        assert 0 <= rows[i].score <= 1 and (rows[i].score > 0) == bool(expected)
    assert len([p for p in rows[10].places if p.base]) == 300


def test_postings_are_intersected_by_place():
    known = licenses.templates()
    index = licenses.Index(known, {})
    listed = {(t, i) for places in index.postings.values() for t, i in places}
    for t, template in enumerate(known):
        own = [i for u, i in listed if u == t]
        assert len(own) >= 2 and all(any(a <= i < b for i in own) for a, b in template.keys)
    mit = next(t for t, x in enumerate(known) if len(x.keys) == 2)
    notice = list(known[mit].words)
    assert index.starts([b"so", *notice]).get(mit) == {1}
    cut = known[mit].keys[1][0]
    # both key phrases, but not at their places; and one alone
    assert mit not in index.starts([*notice[:cut], b"one", b"word", *notice[cut:]])
    assert mit not in index.starts(notice[:cut])


def test_partly_quoted_notice_scores_by_its_words(table):
    row = licenses.scan_licenses(table([(1, "see the mit license")])).first().license
    assert row.labels == ["mit"] and row.score == 0.6  # "the mit license" of "released under the mit license"


def test_awkward_rows(awkward, table):
    found = licenses.scan_licenses(awkward)
    assert found.count() == awkward.count() and set(found.columns) == set(awkward.columns)
    assert found.filter(F.col("text").isNull()).select("license.n_words", "license.score").distinct().collect() == [(0, 0.0)]
    assert licenses.scan_licenses(table([])).count() == 0
