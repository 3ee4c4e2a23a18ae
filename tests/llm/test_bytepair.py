import hashlib
import weakref

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from clipalign.llm import bytepair, queries, text, words

from .conftest import prose

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bytepair.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bytepair.TextEncoder(bytepair.BytePairs(RANKS))
ODD = ["", " ", "\n", "a b", "a  b", " a", "a ", "a\nb", "a \nb", "a\n b", "\n\n x", "x\n", "it's we'll 's x' 'S", "12 3,4.5!?", "é ü 中文 😀 x", "a\tb c",
       "<|endoftext|> x", "a\x1cb\x1c c", "a　 b", "a b", "a" * 5000, "ab" * 3000, " " * 400, "word." * 300, "́́ é", ".", ",", " .", "Z. ", "x.\n"]


def ids(raw: bytes) -> list[int]:
    return memoryview(raw).cast("i").tolist()


@pytest.mark.parametrize("odd", ODD)
def test_odd_texts(odd):
    assert ids(ENCODER.encode([odd])[0]) == LIBRARY.encode_ordinary(odd)


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abthe'sING \n\t.,1é中　\x1c "), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60))
def test_any_text_encodes_as_by_the_library(given_text):
    assert ids(ENCODER.encode([given_text])[0]) == LIBRARY.encode_ordinary(given_text)


@settings(max_examples=500, deadline=None)
@given(st.text("abcdeinorst", max_size=40))
def test_words_merge_as_by_the_library(word):
    assert ENCODER.pairs.encode_word(word.encode()) == LIBRARY.encode_ordinary(word)


def slow_merge(ranks, raw):
    if raw in ranks:
        return [ranks[raw]]
    parts = [raw[i:i + 1] for i in range(len(raw))]
    while True:
        known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not known:
            return [ranks[p] for p in parts]
        i = min(known)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


#: "abab" can't be made by merging "ab" and "ab" while "ba" comes first, so it stands for the whole word only.
TINY = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate([b"ba", b"ab", b"abab", b"aba", b"cc", b"ccc", b"cccc", b"abc"])}
SMALL = bytepair.BytePairs(TINY)


@settings(max_examples=1000, deadline=None)
@given(st.text("abc", max_size=14))
def test_backtracking_gives_the_merges(word):
    assert SMALL.encode_word(word.encode()) == (slow_merge(TINY, word.encode()) if word else [])


@settings(max_examples=1000, deadline=None)
@given(st.integers(0, len(RANKS) - 1), st.integers(0, len(RANKS) - 1))
def test_neighbours_fit_if_merging_their_bytes_gives_them(left, right):
    pairs = ENCODER.pairs
    parts = [pairs.tokens[left], pairs.tokens[right]]
    assert pairs.fits[left * pairs.n + right] == (pairs.merge(b"".join(parts)) == parts)


@given(st.text("ab. \n\t　", max_size=30))
def test_keys_put_the_text_together(some):
    assert "".join(map(text.word_of, text.exact_keys(some))) == some
    parts = list(map(text.word_of, text.word_keys(some)))
    assert None in parts or "".join(parts) == some


def test_words_put_away_come_back(monkeypatch):
    monkeypatch.setattr(words, "AT_HAND", 50)
    encoder = bytepair.TextEncoder(ENCODER.pairs)
    for i in (1, 2, 3, 1, 2):
        texts = [prose(i, 200), "a  b", "x.\n", prose(i + 1, 100)]
        assert [ids(x) for x in encoder.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_a_worker_keeps_few_words(monkeypatch):
    monkeypatch.setattr(bytepair, "WORDS", 60)
    monkeypatch.setattr(bytepair, "FREQUENT_WORDS", 30)
    encoder = bytepair.TextEncoder(ENCODER.pairs)
    for i in range(12):
        some = f"{prose(i % 4, 40)} w{i}x."
        assert ids(encoder.encode([some])[0]) == LIBRARY.encode_ordinary(some)
        assert len(encoder.words.words) < 60 + 80


def test_a_worker_that_decodes_gives_back_its_encoder():
    encoder = weakref.ref(bytepair.text_encoder(PATH, public_tokenizers.PATTERN))
    assert encoder() is not None
    bytepair.let_go()
    assert encoder() is None


def test_ranks_without_a_byte_are_refused():
    with pytest.raises(ValueError):
        bytepair.BytePairs({b"a": 0})


def test_another_pattern(table):
    rows = bytepair.encode_texts(table([(1, "a b-c"), (2, "the the")]), PATH, r"[^-]+|-").collect()
    other = tiktoken.Encoding("other", pat_str=r"[^-]+|-", mergeable_ranks=RANKS, special_tokens={})
    assert [r.encoded.ids for r in sorted(rows)] == [other.encode_ordinary("a b-c"), other.encode_ordinary("the the")]


def test_tables_encode_and_decode(spark, table, awkward):
    texts = [*ODD, prose(1, 3000), None, "x", "x"]
    done = bytepair.decode_ids(bytepair.encode_texts(table(list(enumerate(texts))), PATH), F.col("encoded.ids"), PATH).collect()
    assert {r.doc_id: r.encoded.ids for r in done} == {i: LIBRARY.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.decoded.raw) for r in done} == {i: (t or "").encode() for i, t in enumerate(texts)}
    kept = bytepair.decode_ids(bytepair.encode_texts(awkward, PATH), F.col("encoded.ids"), PATH)
    assert sorted(map(str, kept.select(awkward.columns).collect())) == sorted(map(str, awkward.collect()))
    assert bytepair.encode_texts(table([]), PATH).count() == 0
    assert bytepair.encode_texts(awkward.withColumnRenamed("n_chars", "encoded"), PATH).columns.count("encoded") == 1


def test_many_rows_and_null_ids_decode(spark):
    rows = spark.range(1500).select("id", F.when(F.col("id") % 7 < 6, F.array(F.col("id").cast("int"), F.lit(11))).alias("ids"))
    for some in (rows, rows.where("ids is not null")):
        found = {r.id: r.decoded.raw for r in bytepair.decode_ids(some, F.col("ids"), PATH).collect()}
        assert found == {i: LIBRARY.decode_bytes([i, 11]) if i % 7 < 6 else None for i in range(1500) if some is rows or i % 7 < 6}


def test_query_equals_the_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.op13_bytepair(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for d in docs:
        own, r = LIBRARY.encode_ordinary(d.text or ""), found[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
