import re

from hypothesis import given, strategies as st

from clipalign.llm.text import plain_words, spaced_words

PLAIN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile("[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_words_are_those_of_the_patterns(text):
    raw = text.encode()
    assert [w.decode() for w in plain_words(raw)] == PLAIN.findall(lower_ascii(text))
    assert [w.decode() for w in spaced_words(raw)] == SPACED.findall(lower_ascii(text))


def test_null_has_no_words():
    assert plain_words(None) == [] == spaced_words(None)
