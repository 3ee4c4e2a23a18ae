"""Scalar column expressions: rounding rules, hash-based randomness and string clean-up."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F


def truncate(c: Column) -> Column:
    """Integer part, towards zero."""
    return c.cast("double").cast("bigint")


def half_even(c: Column, digits: int = 0) -> Column:
    """Banker's rounding of a double."""
    return F.bround(c.cast("double"), digits)


def clamp(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, c))


def seeded_digest(seed: str, *keys: Column) -> Column:
    """md5 of ``seed:key[:key...]``; its text order is the repeatable shuffle order."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]))


def uniform(seed: str, *keys: Column) -> Column:
    """Repeatable number in [0, 1) from the first 32 bits of the seeded digest."""
    head = F.substring(seeded_digest(seed, *keys), 1, 8)
    return F.conv(head, 16, 10).cast("bigint").cast("double") / F.lit(float(2**32))


def uniform_int(seed: str, low: Column, high: Column, *keys: Column) -> Column:
    """Repeatable integer in [low, high], both ends included."""
    return low + F.floor(uniform(seed, *keys) * (high - low + 1)).cast("bigint")


def six_digit_key(c: Column) -> Column:
    """Six significant digits without trailing zeros; with an exponent outside magnitudes of [1e-4, 1e6)."""
    value = c.cast("double")
    digits = F.greatest(F.lit(0.0), F.lit(5.0) - F.floor(F.log10(F.abs(value))))
    scale = F.pow(F.lit(10.0), digits)
    text = F.format_string("%.9f", F.bround(value * scale) / scale)
    trimmed = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    powered = F.format_string("%.5e", value)
    exponent = F.regexp_extract(powered, r"e([+-]\d+)$", 1)
    mantissa = F.regexp_replace(F.regexp_extract(powered, r"^(.*)e", 1), r"\.?0+$", "")
    far = ~exponent.cast("int").between(-4, 5)
    return F.when(value == 0, F.lit("0")).when(far, F.concat(mantissa, F.lit("e"), exponent)).otherwise(trimmed)


def padded(c: Column, width: int) -> Column:
    """A whole number as text of at least ``width`` digits; longer numbers stay whole."""
    text = c.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def slug(c: Column) -> Column:
    """Lower case, every run of other characters to one underscore, no outer underscores."""
    lowered = F.lower(F.trim(c))
    return F.trim(F.regexp_replace(lowered, r"[^a-z0-9_]+", "_"), F.lit("_"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    """Name of the folder that holds the file, empty at the top."""
    return F.regexp_extract(path, r"([^/]+)/+[^/]+/*$", 1)


def safe_stem(path: Column, default: str = "video") -> Column:
    """Stem with everything but letters, digits, dash, dot and underscore replaced."""
    cleaned = F.regexp_replace(stem(path), r"[^\p{L}\p{N}\-_.]", "_")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def bounded_slug(text: Column, max_length: int = 96, default: str = "input") -> Column:
    """File-system slug: runs of odd characters to a double underscore, outer marks cut, length bounded."""
    cleaned = F.trim(F.regexp_replace(text, r"[^A-Za-z0-9._=\-]+", "__"), F.lit("._-"))
    return F.substring(F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default)), 1, max_length)


def shard_name(sample_id: Column) -> Column:
    """Base name of the shard in ``shard::member``."""
    shard = F.substring_index(sample_id, "::", 1)
    return F.coalesce(F.nullif(file_name(shard), F.lit("")), shard)


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    parts = [clamp(half_even(c * 255.0).cast("int"), F.lit(0), F.lit(255)) for c in (r, g, b)]
    return F.format_string("#%02x%02x%02x", *parts)


def unescape_entities(c: Column, times: int = 1) -> Column:
    """Undo named and numeric HTML entities. Only texts with an ampersand go through Python."""

    @F.pandas_udf("string")
    def undo(texts: pd.Series) -> pd.Series:
        def one(text):
            for _ in range(times if text is not None else 0):
                text = html.unescape(text)
            return text

        return texts.map(one)

    return F.coalesce(undo(F.when(F.contains(c, F.lit("&")), c)), c)


def clean_caption(c: Column) -> Column:
    """Undo HTML entities twice, collapse white space of any script, trim and lower."""
    return F.lower(F.trim(F.regexp_replace(unescape_entities(c, 2), r"(?U)\s+", " ")))


# Fixed value: the word pattern of the caption tokeniser.
CAPTION_WORD = r"<start_of_text>|<end_of_text>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def caption_words(c: Column) -> Column:
    return F.regexp_extract_all(clean_caption(c), F.lit(CAPTION_WORD), 0)
