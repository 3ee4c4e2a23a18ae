import random
import zlib

import pytest
from pyspark.sql import functions as F

from clipalign.llm import language, queries

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_ranges(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "text")
    rows = queries.op7_language_id(spark, SF_DIR).join(docs, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    tested = [r for r in rows if r.held_out and len(r.text) > 100]
    assert sum(r.lang_pred == r.lang for r in tested) / len(tested) > 0.96
    assert len(rows) == docs.count()


@pytest.fixture
def model(table):
    rows = [(i, text * 3, lang) for i in range(40) for lang, text in (("aa", f"kala mala tola {i} "), ("bb", f"stritz brontz krug {i} "))]
    return language.learn(table([(i, t, lang, None) for i, t, lang in rows]), F.lit(True))


def test_learned_languages_and_unknown_texts(table, model):
    assert sorted(model.languages) == ["aa", "bb"] and all(len(d) <= language.DICTIONARY_BYTES for d in model.dictionaries)
    docs = table([(1, "mala kala tola kala mala"), (2, "KRUG STRITZ BRONTZ krug"), (3, None), (4, ""), (5, "123 ... !"), (6, "kala mala tola " * 9000)])
    found = {r.doc_id: r.language for r in language.predict(docs, model).collect()}
    assert [found[i].lang for i in (1, 2, 6)] == ["aa", "bb", "aa"] and all(found[i].accepted for i in (1, 2, 6))
    assert {(found[i].lang, found[i].score, found[i].accepted) for i in (3, 4, 5)} == {("und", 0.0, False)}


def test_narrow_margins_are_rejected(table, model):
    docs = table([(1, "zzz qqq"), (2, "mala kala tola kala mala")])
    assert [r.language.accepted for r in language.predict(docs, model, min_margin=0.9).orderBy("doc_id").collect()] == [False, False]


def test_a_winner_of_votes_that_needs_more_bytes_in_all_is_rejected(table, model):
    # the first block goes narrowly to one language by most bytes, the second clearly to the other
    draw = random.Random(3)
    strange = " ".join("".join(draw.choices("qxyz", k=5)) for _ in range(70))
    texts = [(strange + f" {'kala mala tola ' * a}")[:512] + " " + ("stritz brontz krug " * 20)[:b] for a in range(0, 8) for b in range(20, 380, 20)]
    found = [r.language for r in language.predict(table(list(enumerate(texts))), model).collect()]
    sizes = [[sum(len(c(raw[at:at + language.BLOCK])) for at in range(0, len(raw), language.BLOCK)) for c in model.compressors()]
             for raw in map(language.letters_only, texts)]
    beaten = [(r, s) for r, s in zip(found, sizes) if s[model.languages.index(r.lang)] > min(s)]
    assert beaten and all(r.margin < 0 and not r.accepted for r, _ in beaten)
    assert all(r.margin >= 0 for r, s in zip(found, sizes) if s[model.languages.index(r.lang)] == min(s))


def test_only_usable_labelled_rows_teach(table):
    docs = table([(1, "aaa", "x", None), (2, "bbb", None, None), (3, None, "y", None), (4, "ccc", "z", None)])
    assert language.learn(docs, F.col("doc_id") != 4).languages == ["x"]
    empty = language.learn(table([]), F.lit(True))
    assert empty.languages == [] and language.predict(docs, empty).select("language.lang").distinct().collect() == [("und",)]


def test_a_shared_passage_at_the_start_does_not_fill_the_dictionaries(table):
    header = "this page is a copy " * 75
    rows = [(i, header + text * 200, lang, None) for i in range(30) for lang, text in (("aa", "kala mala tola "), ("bb", "stritz brontz krug "))]
    learned = language.learn(table(rows), F.lit(True))
    for lang, word in (("aa", b"kala"), ("bb", b"stritz")):
        dictionary = learned.dictionaries[learned.languages.index(lang)]
        assert dictionary.count(word) > 200 and len(dictionary) <= language.DICTIONARY_BYTES


def test_awkward_rows(awkward, table, model):
    found = language.predict(awkward, model)
    assert found.count() == awkward.count() and set(found.columns) == set(awkward.columns)
    assert language.predict(table([]), model).count() == 0
