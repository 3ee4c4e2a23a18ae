import hashlib
import weakref
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clipalign.llm import alignment, queries, words
from clipalign.llm.tokencount import byte_letters

from .conftest import prose

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SIDE_A = Tokenizer.from_file(A)
SIDE_A.encode_special_tokens = True
SIDE_B = sentencepiece.SentencePieceProcessor(model_file=B)
LETTERS = byte_letters()
ALIGNER = alignment.Aligner(alignment.byte_level(A), alignment.piece_level(B))
ODD = ["a", " ", "  ", "a ", " a", "a  b", "a\nb", "a \n b\n", "\n", "\n\nx", "word's 12,3!", "é ü 中文 😀 x", "a▁b", "▁", "a\tb\x1c c", "<|endoftext|> <s> x", "　x　y",
       "́e", "ab" * 500, "the " * 50, "x\x00y", "end\n", "\ta b", " \nx"]


def slow(text):
    """The groups of a text as lists of ids, or None if it has no tokens."""
    if not text:
        return None
    raw = (" " + text).encode()
    a = [(i, bytes(LETTERS[c] for c in SIDE_A.id_to_token(i))) for i in SIDE_A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in SIDE_B.encode(text):
        piece = SIDE_B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if SIDE_B.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return None
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
    shared = sorted(set(ends[0]) & set(ends[1]))
    groups = [[[], []] for _ in shared]
    for k, (side, at) in enumerate(zip((a, b), ends)):
        for (i, _), e in zip(side, at):
            groups[bisect_left(shared, e)][k].append(i)
    return groups


def shown(groups):
    return hashlib.sha256(";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups).encode()).hexdigest() if groups else ""


def check(text):
    tokens, digest = ALIGNER.align([text])[0]
    a, b, sizes = (x.to_pylist()[1] for x in alignment.unravel([b"", tokens, tokens]))
    groups = slow(text) or []
    assert a == [i for g in groups for i in g[0]] and b == [i for g in groups for i in g[1]]
    assert sizes == [len(side) for g in groups for side in g]
    assert digest == shown(groups)


@pytest.mark.parametrize("text", [None, "", *ODD])
def test_odd_texts(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abthe'sING.,1é!#_"), min_size=1, max_size=12), min_size=1, max_size=30, unique=True))
def test_words_in_one_go_align_as_one_by_one(parts):
    sides = ALIGNER.sides
    spaced = [" " + p for p in parts]
    alone = [alignment.align_ids(*sides, *x) for x in zip(spaced, sides[0].ids(spaced), sides[1].ids(spaced))]
    assert alignment.align_words(*sides, parts) == alone


def test_words_whose_bytes_a_side_changes_are_not_aligned_in_one_go():
    assert alignment.align_words(*ALIGNER.sides, ["a", "b▁c"]) is None


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abthe'sING \n\t.,1é中▁　\x1c "), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_aligns_as_by_the_libraries(text):
    check(text)


def test_words_put_away_come_back(monkeypatch):
    monkeypatch.setattr(words, "AT_HAND", 40)
    texts = [prose(1, 100), "a▁b", "a  b", *ODD, prose(2, 90)]
    own = alignment.Aligner(*ALIGNER.sides)
    first = own.align(texts)
    for _ in range(3):
        assert own.align(texts) == first == ALIGNER.align(texts)


@given(st.sets(st.integers(0, 200)), st.sets(st.integers(0, 200)))
def test_gallop(longer, shorter):
    found = alignment.gallop(sorted(longer), sorted(shorter))
    assert found == [(sorted(longer).index(x), sorted(shorter).index(x)) for x in sorted(longer & shorter)]


def test_pairs_of_long_groups(monkeypatch):
    draw = np.random.default_rng(1)
    sizes = np.array([3, 4, 1, 1, 40, 50, 0, 0, 2, 1, 5, 5], dtype=np.int32)
    a, b = draw.integers(0, 9, sizes[0::2].sum()).astype(np.int32), draw.integers(0, 9, sizes[1::2].sum()).astype(np.int32)
    expected, i, k = Counter(), 0, 0
    for n, m in zip(sizes[0::2], sizes[1::2]):
        expected.update((int(x) << alignment.ID_BITS) | int(y) for x in a[i:i + n] for y in b[k:k + m])
        i, k = i + n, k + m
    for links in (1, 7, 30, 10_000):
        monkeypatch.setattr(alignment, "LINKS", links)
        pairs, counts = alignment.pairs_of(a, b, sizes)
        assert dict(zip(pairs.tolist(), counts.tolist())) == expected and (np.diff(pairs) > 0).all()


def expected_rows(texts):
    linked = [Counter((x, y) for g in slow(t) or [] for x in g[0] for y in g[1]) for t in texts]
    docs = Counter(pair for c in linked for pair in c)
    highest = defaultdict(int)
    for (x, _), n in docs.items():
        highest[x] = max(highest[x], n)
    rows = []
    for t, c in zip(texts, linked):
        groups = slow(t) or []
        rows.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(c.values()),
                     sum(n for p, n in c.items() if docs[p] == highest[p[0]]), sum(n * docs[p] for p, n in c.items()), shown(groups)))
    return rows


@pytest.mark.parametrize("frequent", [1, 40, 1 << 19])
def test_links_with_few_and_many_broadcast_pairs(table, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "PAIRS", 50)
    texts = [*ODD, None, "", prose(1, 300), prose(2, 500), prose(1, 300), "the cat, the cat", "the cat"]
    aligned = alignment.align(table(list(enumerate(texts))), A, B)
    scored = aligned.join(alignment.score_links(aligned, alignment.pair_counts(aligned), "doc_id"), "doc_id").collect()
    found = {r.doc_id: (len(r.alignment.a), len(r.alignment.b), len(r.alignment.sizes) // 2, r.n_links, r.n_best, r.count_sum, r.alignment.groups_sha256)
             for r in scored}
    assert found == dict(enumerate(expected_rows(texts)))


def test_packed_tokens_give_the_same_links(table, awkward):
    texts = [*ODD, None, "", "x", "x", prose(1, 300), prose(2, 200), prose(1, 300)]
    for rows in (table(list(enumerate(texts))), table([(1, None)]), table([])):
        found = []
        for packed in (False, True):
            aligned = alignment.align(rows, A, B, packed=packed)
            counts = alignment.pair_counts(aligned)
            links = alignment.score_links(aligned, counts, "doc_id")
            found.append((sorted(map(tuple, counts.collect())), sorted(map(tuple, links.collect()))))
        assert found[0] == found[1]
        lists = alignment.align(rows, A, B).selectExpr("doc_id", "size(alignment.a)", "size(alignment.b)", "size(alignment.sizes) div 2", "alignment.groups_sha256")
        packs = aligned.select("doc_id", "alignment.n_a", "alignment.n_b", "alignment.n_groups", "alignment.groups_sha256")
        assert sorted(map(tuple, packs.collect())) == sorted(map(tuple, lists.collect()))


def test_a_worker_gives_back_its_aligner():
    own = weakref.ref(alignment.aligner(A, B))
    assert own() is not None
    alignment.let_go()
    assert own() is None


def test_awkward_and_empty_tables(awkward, table):
    aligned = alignment.align(awkward.withColumn("links", F.lit(1)).withColumn("pair", F.lit(2)).withColumn("row", F.monotonically_increasing_id()), A, B)
    assert sorted(map(str, aligned.select(awkward.columns).collect())) == sorted(map(str, awkward.collect()))
    assert alignment.score_links(aligned, alignment.pair_counts(aligned), "row").count() == awkward.count()
    empty = alignment.align(table([]), A, B)
    assert alignment.score_links(empty, alignment.pair_counts(empty), "doc_id").count() == 0
    nothing = alignment.align(table([(1, None), (2, "")]), A, B)
    assert [tuple(r)[1:] for r in alignment.score_links(nothing, alignment.pair_counts(nothing), "doc_id").collect()] == [(0, 0, 0)] * 2


def test_query_equals_the_slow_reading(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = {r.doc_id: tuple(r[n] for n in names) for r in queries.op11_alignment(spark, sf_dir).collect()}
    assert found == dict(zip([d.doc_id for d in docs], expected_rows([d.text for d in docs])))


def test_words_beside_other_white_space_are_aligned_once():
    asked = []
    own = alignment.Aligner(*(alignment.Side(lambda parts, s=s: [asked.extend(parts), s.ids(parts)][1], s.raw) for s in ALIGNER.sides))
    text = prose(3, 30) + "\n\n" + prose(4, 30) + "  éa\tb"
    first = own.align([text])
    assert first == ALIGNER.align([text])
    asked.clear()
    assert own.align([text, text + " éa"])[0] == first[0]
    # what has white space of its own in front, and the new word at the end
    assert all(p[:2] in ("\n\n", "  ", " é") or "\t" in p for p in asked)
