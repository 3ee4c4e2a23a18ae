import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from clipalign.llm import tokencount, tokenfiles, wordtable

from .conftest import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ENCODER = tokenfiles.Encoder(PATH)
ODD = ["a b", "a  b", " a", "a ", "a\nb", "a \nb", "a\n b", "\n", "a b", "it's we'll 's x'", "12 3,4.5!?", "é ü 中文 😀 x", "a\tb c", "<|endoftext|> x",
       "one\ntwo three\n\nfour", " wide", "tab\t", "a\x1cb c", "don 't", "a ' s"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_encode_as_by_the_library(plain, text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab'st \n\t.,1é中 "), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_encodes_as_by_the_library(text):
    t = Tokenizer.from_file(PATH) if not hasattr(ENCODER, "plain") else ENCODER.plain
    ENCODER.plain = t
    t.encode_special_tokens = True
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_small_memories_and_punctuation_give_the_same_ids(plain, monkeypatch):
    monkeypatch.setattr(tokenfiles, "AT_HAND", 20)
    monkeypatch.setattr(tokenfiles, "COMMON", 10)
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 200)
    encoder = tokenfiles.Encoder(PATH)
    ends = ["", ",", ".", "...", "!?", "###", "'", "',", ",'s", "%%%%%%", "$1", "_", "²", "."]
    for i in range(60):
        texts = [" ".join(w + ends[(i + j + k) % len(ends)] for k, w in enumerate(prose(j % 9, 12).split(" "))) for j in range(i, i + 8)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [plain(t) for t in texts]


def test_files_read_back_as_written(spark, table, tmp_path, plain):
    rows = [(i * 7 % 50, prose(i, 5 * i)) for i in range(50)] + [(60, None), (61, ""), (62, "x"), (62, "x"), (None, "no id")]
    path = f"{tmp_path}/tokens"
    tokenfiles.write_tokens(table(rows), path, PATH)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfiles.with_crc(tokenfiles.read_tokens(spark, path)).collect())
    start, expected = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain(text), 0]
        expected.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    assert {r.doc_id for r in tokenfiles.find_tokens(spark, path, [62, 7]).collect()} == {62, 7}


def test_awkward_tables_are_written(spark, awkward, table, tmp_path):
    tokenfiles.write_tokens(awkward, f"{tmp_path}/a", PATH)
    assert tokenfiles.with_crc(tokenfiles.read_tokens(spark, f"{tmp_path}/a")).count() == awkward.count()
    tokenfiles.write_tokens(table([]), f"{tmp_path}/b", PATH)
    assert tokenfiles.read_tokens(spark, f"{tmp_path}/b").count() == 0


LIBRARY = Tokenizer.from_file(PATH)
END_OF_TEXT = ["end of page <|endoftext|> next", "a<|endoftext|>b", "<|endoftext|>", "one\n<|endoftext|>\ntwo", "<|endoftext| > x", "no such token"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "a", "word", ".", "<"]), max_size=12).map("".join))
def test_added_tokens_encode_as_by_the_unmodified_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids if text else []
    assert np.frombuffer(tokenfiles.encoder(PATH).encode([text])[0], "<u4").tolist() == ids


def test_files_hold_added_tokens_as_the_unmodified_library_encodes_them(spark, table, tmp_path):
    tokenfiles.write_tokens(table(list(enumerate(END_OF_TEXT))), f"{tmp_path}/t", PATH)
    rows = tokenfiles.read_tokens(spark, f"{tmp_path}/t").orderBy("start").collect()
    expected = [[*LIBRARY.encode(t, add_special_tokens=False).ids, 0] for t in END_OF_TEXT]
    assert [list(r.ids) for r in rows] == expected
    assert [r.start for r in rows] == [sum(map(len, expected[:i])) for i in range(len(expected))]


def greedy(word, vocabulary, longest):
    n = at = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at:at + k] in vocabulary)
        n += 1
    return n


SMALL = {bytes([b]) for b in range(256)} | {b"abcd", b"ab", b"abcde", b"bc", b"cdx", b"bcdxy", b" a", b" abc", b"xx", b"xxx", b"xxxxx"}
MACHINE = tokencount.Automaton(SMALL)


@given(st.text("abcdexy ", max_size=30))
def test_automaton_counts_greedy_matches(word):
    raw = word.encode()
    assert MACHINE.count(raw) == greedy(raw, SMALL, 5)


def test_counts_equal_greedy_matches_of_the_vocabulary(table, awkward):
    vocabulary = tokencount.read_vocabulary(PATH)
    longest = max(map(len, vocabulary))
    texts = [prose(1, 300), "The and attion, thanedble!!! été 中文\n\n x", None, "", " \t\n", "supercalifragilistic " * 50]
    rows = {r.doc_id: r.tokens for r in tokencount.count_tokens(table(list(enumerate(texts))), vocabulary).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        assert tuple(rows[i]) == (len(words), sum(greedy(b" " + w, vocabulary, longest) for w in words))
    assert tokencount.count_tokens(awkward, vocabulary).count() == awkward.count()
    assert tokencount.count_tokens(table([]), vocabulary).count() == 0


def test_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError):
        tokencount.Automaton({b"a"})


def test_words_that_came_before_are_not_encoded_again(plain, monkeypatch):
    encoder, asked = tokenfiles.Encoder(PATH), []
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: [asked.extend(texts), ids(texts)][1])
    texts = [prose(i, 40) for i in range(20)]
    first = encoder.encode(texts)
    asked.clear()
    assert encoder.encode([f"{t}\n{t}." for t in texts[:5]] + texts)[5:] == first
    assert encoder.encode(texts) == first == [np.array(plain(t), "<u4").tobytes() for t in texts]
    asked.clear()
    assert encoder.encode(texts[::-1]) == first[::-1]
    assert not asked


def test_words_of_equal_hash_have_their_own_ids(plain, monkeypatch):
    monkeypatch.setattr(wordtable, "_hashes", lambda words: np.array([len(w) % 3 for w in words], np.int64))
    encoder = tokenfiles.Encoder(PATH)
    for i in range(4):
        texts = [prose(i, 30), prose(i + 1, 30), *ODD]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [plain(t) for t in texts]


def test_workers_let_go_of_words_when_done(monkeypatch):
    monkeypatch.setattr(tokenfiles, "flat", lambda df, schema, make: make)
    tokens = SimpleNamespace(select=lambda *columns: None)
    tokenfiles.encoder(PATH)
    tokenfiles.with_crc(tokens)()
    assert tokenfiles.encoder.cache_info().currsize == 1
    tokenfiles.with_crc(tokens, done=True)()
    assert tokenfiles.encoder.cache_info().currsize == 0
