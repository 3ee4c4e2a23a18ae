"""Line-first quality rules in DataFrame functions alone.

Each line is judged by itself; lines that fail go, and a document that loses too much of its text goes too. Documents with hardly any
words, or whose words mostly stand in repeated windows, have failed before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Phrases of boilerplate and navigation lines.
BOILERPLATE = ("(?i)(all rights reserved|cookie|privacy policy|terms of (use|service)|click here|read more|sign (in|up)|subscribe|"
               "lorem ipsum|enable javascript|share this)")
ENDING = r"[.!?:;,\"')\]”»…。！？][\x20\x09-\x0D]*$"
#: A line of fewer words without an end mark is no sentence; one of fewer words with a boilerplate phrase is boilerplate.
SHORT_LINE = 12
BOILERPLATE_LINE = 20
#: Share of a document's characters, without blank lines, that its kept lines must have.
MIN_KEPT = 0.5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, n: Column) -> Column:
    """Words inside windows of five words that occur at least twice, the first occurrence included."""
    def covered(pairs: Column) -> Column:
        # equal windows stand together; their places, in order, cover at most five words each
        last = F.size(pairs) - 1
        marked = F.transform(pairs, lambda p, j: F.when(
            ((j > 0) & (pairs[F.greatest(j - 1, F.lit(0))]["w"] == p["w"]))
            | ((j < last) & (pairs[F.least(j + 1, last)]["w"] == p["w"])), p["i"]))
        return _let(F.sort_array(F.filter(marked, lambda i: i.isNotNull())), lambda at: F.aggregate(
            F.transform(at, lambda i, k: F.when(k < F.size(at) - 1, F.least(F.lit(WINDOW), at[F.least(k + 1, F.size(at) - 1)] - i))
                        .otherwise(F.lit(WINDOW))),
            F.lit(0).cast("bigint"), lambda total, x: total + x))

    windows = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))
    counted = _let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0).cast("bigint")).otherwise(
        _let(F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), covered)))
    return F.when(n > WINDOW, counted).otherwise(F.lit(0).cast("bigint"))


def failing(line: Column) -> Column:
    """True for lines of navigation, symbols, capitals, repetition, boilerplate, and short ones without an end mark."""
    def judged(words: Column) -> Column:
        n, size = F.size(words), F.length(line)
        bars = size - F.length(F.replace(line, F.lit("|"), F.lit("")))
        symbols = F.regexp_count(line, F.lit(SYMBOLS))
        capitals = F.regexp_count(line, F.lit(r"\p{Lu}"))
        return ((bars >= 3) | (symbols * 10 > size) | ((capitals * 2 > size) & (n >= 5))
                | ((n >= 20) & (F.size(F.array_distinct(words)) * 10 < n * 3))
                | ((n < SHORT_LINE) & ~line.rlike(ENDING))
                | ((n < BOILERPLATE_LINE) & line.rlike(BOILERPLATE)))

    return _let(_words(line), judged)


def judge(docs: DataFrame, min_kept: float = MIN_KEPT, into: str = "quality") -> DataFrame:
    """Add struct `into`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines (with a word), n_failed_lines,
    kept_share (of the characters of lines with a word), kept, clean_text (the lines that passed).

    Null and empty texts have no words, so they fail. Repeated rows give equal results each. An existing column `into` is replaced, and
    all others pass through.
    """
    names = [c for c in docs.columns if c != into]
    text = F.coalesce("text", F.lit(""))
    parts = docs.select(*[F.col(f"`{c}`") for c in names], _words(text).alias("__words"),
                        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
                        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("__symbols"))
    lines = F.transform("__lines", lambda x: F.struct(x.alias("line"), failing(x).alias("failed")))
    counted = parts.select(*[F.col(f"`{c}`") for c in names], "__symbols", lines.alias("__judged"), F.size("__words").alias("__n"),
                           F.length(F.array_join("__words", "")).cast("bigint").alias("__chars"),
                           (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("__dup"),
                           repeated_words(F.col("__words"), F.size("__words")).alias("__repeat"))

    def chars(which) -> Column:
        return F.aggregate(F.filter("__judged", which), F.lit(0).cast("bigint"), lambda t, x: t + F.length(x["line"]))

    kept = F.filter("__judged", lambda x: ~x["failed"])
    measured = counted.select(*[F.col(f"`{c}`") for c in names], "__symbols", "__n", "__chars", "__dup", "__repeat",
                              F.size("__judged").alias("__n_lines"), F.size(kept).alias("__n_kept"), chars(lambda x: F.lit(True)).alias("__all"),
                              chars(lambda x: ~x["failed"]).alias("__left"),
                              F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("__clean"))
    failed = (F.col("__n") < 10) | (100 * F.col("__repeat") > 20 * F.col("__n"))
    share = F.when(F.col("__all") > 0, F.col("__left") / F.col("__all")).otherwise(F.lit(0.0))
    made = F.struct(F.col("__n").cast("bigint").alias("n_words"), F.col("__chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"),
                    F.col("__dup").alias("n_dup_lines"), F.col("__repeat").alias("n_repeat_words"), failed.alias("base_failed"),
                    F.col("__n_lines").cast("bigint").alias("n_lines"),
                    (F.col("__n_lines") - F.col("__n_kept")).cast("bigint").alias("n_failed_lines"), share.alias("kept_share"),
                    (~failed & (share >= min_kept)).alias("kept"), F.col("__clean").alias("clean_text"))
    return measured.select(*[F.col(f"`{c}`") for c in names], made.alias(into))
