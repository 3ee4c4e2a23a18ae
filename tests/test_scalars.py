import html
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipalign.functions import audio, scalars, vectors


def _one(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_six_digit_key_matches_percent_g(spark):
    values = [0.0, 0.2, -1.6, 2.0, 1.555556, 100.0, 123456.7, 0.00012345678, -99.99999, 0.1 + 0.2, 1234567.0, 0.00001234, 999999.7, -1e20, 2.5e-7, 1e6, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert _one(df, scalars.six_digit_key(F.col("v"))) == [f"{v:.6g}" for v in values]


def test_stems_follow_path_rules(spark):
    paths = ["/a/b/clip.v1.mp4", "x.tar.gz", "/a/.hidden", "/a/b/", "noext", "/q/naïve file!.mov"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    want = [os.path.splitext(os.path.basename(p.rstrip("/")))[0] for p in paths]
    assert _one(df, scalars.stem(F.col("p"))) == want
    safe = ["".join(c if c.isalnum() or c in "-_." else "_" for c in w) or "video" for w in want]
    assert _one(df, scalars.safe_stem(F.col("p"))) == safe


def test_slug(spark):
    df = spark.createDataFrame([("  My Model--V2! ",), ("___",), ("a_b",)], "s string")
    assert _one(df, scalars.slug(F.col("s"))) == ["my_model_v2", "", "a_b"]


def test_shard_name(spark):
    df = spark.createDataFrame([("/d/s-1.tar::a/b.mp4",), ("plain.mp4",)], "s string")
    assert _one(df, scalars.shard_name(F.col("s"))) == ["s-1.tar", "plain.mp4"]


def test_caption_clean_undoes_entities_twice(spark):
    texts = ["A &amp;amp; B", " x\n\t y ", "&quot;Hi&quot; &amp;lt;b&gt;", "a\u00a0\u2003b  c\u3000", "x&nbsp;y", "&copy; &middot; &eacute;&#233;&#x27; &hellip;", "no &such; thing & so"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    want = [re.sub(r"\s+", " ", html.unescape(html.unescape(t)).strip()).strip().lower() for t in texts]
    assert _one(df, scalars.clean_caption(F.col("s"))) == want


def test_rounding_and_truncation(spark):
    df = spark.createDataFrame([(2.5,), (-1.7,), (3.5,)], "v double")
    assert _one(df, scalars.half_even(F.col("v"))) == [2.0, -2.0, 4.0]
    assert _one(df, scalars.truncate(F.col("v"))) == [2, -1, 3]


def test_softmax_and_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0],)], "v array<double>")
    row = df.select(vectors.softmax(F.col("v")).alias("p"), vectors.top_classes(F.col("v"), 3).alias("t")).head()
    e = np.exp(np.array([1.0, 3.0, 3.0, -2.0]))
    assert row["p"] == pytest.approx(list(e / e.sum()))
    assert row["t"] == [1, 2, 0]


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    assert _one(df, vectors.l2_normalize(F.col("v"))) == [[0.0, 0.0]]


def test_noise_repeats_and_has_the_amplitude(spark):
    df = spark.range(200).withColumn("v", F.array_repeat(F.lit(0.0), 50))
    noisy = audio.add_noise(F.col("v"), 0.01, "n", F.col("id"))
    first, second = (np.array(_one(df, noisy)) for _ in range(2))
    assert np.array_equal(first, second)
    assert abs(first.std() - 0.01) < 0.0005 and abs(first.mean()) < 0.0005
    assert not math.isclose(first[0][0], first[1][0])


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([(7,), (12345,)], "n long")
    assert _one(df, scalars.padded(F.col("n"), 4)) == ["0007", "12345"]


def test_special_tokens_stay_whole(spark):
    df = spark.createDataFrame([("<start_of_text>It's 42 <end_of_text>!",)], "s string")
    assert _one(df, scalars.caption_words(F.col("s")))[0] == ["<start_of_text>", "it", "'s", "4", "2", "<end_of_text>", "!"]
