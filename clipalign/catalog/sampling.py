"""Split and sampling queries; the seeded order is the md5 text order of ``seed:key``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign import views
from clipalign.catalog import query, tidy
from clipalign.catalog.ctes import TOKENS, digest, double_list, uniform, with_ctes
from clipalign.catalog.curation import CORPUS, _corpus
from clipalign.operators import evaluation as ev, joining as jo, sampling as sa

SEED = "1337"
GRID21 = ev.offset_grid(-2.0, 2.0, 21)


@query("stratified_valid_split", with_ctes([CORPUS, f"""
want AS (SELECT label, count(*) AS n FROM corpus WHERE split = 'test' GROUP BY 1)""", f"""
tr AS (SELECT video_id, label, row_number() OVER (PARTITION BY label ORDER BY {digest(SEED, "video_id")}, video_id) AS r
       FROM corpus WHERE split = 'train')""", """
vid AS (SELECT video_id, CASE WHEN r <= n THEN 'valid' ELSE 'train' END AS split FROM tr LEFT JOIN want USING (label)
        UNION ALL SELECT video_id, 'test' FROM corpus WHERE split = 'test')"""], """
SELECT c.clip_id, c.video_id, v.split FROM corpus c JOIN labels USING (doc_id) JOIN vid v USING (video_id)"""))
def stratified_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    there = corpus.join(views.table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("clip_id", "video_id")
    return sa.stratified_valid_split(corpus.select("video_id", "label", "split"), there, SEED)


@query("group_split_8_1_1", with_ctes([f"""
g AS (SELECT o_custkey, row_number() OVER (ORDER BY {digest(SEED, "o_custkey")}, o_custkey) AS r, count(*) OVER () AS n
      FROM (SELECT DISTINCT o_custkey FROM orders))"""], """
SELECT o_orderkey, o_custkey, CASE WHEN r <= trunc(n * 0.1::DOUBLE) THEN 'test' WHEN r <= 2 * trunc(n * 0.1::DOUBLE) THEN 'valid'
  ELSE 'train' END AS split FROM orders JOIN g USING (o_custkey)"""))
def group_split_8_1_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sa.group_split(orders, "o_custkey", SEED)


@query("subsample_ratio", with_ctes([f"""
r AS (SELECT doc_id, row_number() OVER (ORDER BY {digest(SEED, "doc_id")}, doc_id) AS r, count(*) OVER () AS n FROM documents)"""], """
SELECT doc_id, 'at least one' AS mode FROM r WHERE r <= greatest(1, trunc(n * 0.137::DOUBLE))
UNION ALL SELECT doc_id, 'no floor' FROM r WHERE r <= trunc(n * 0.0715::DOUBLE)
UNION ALL SELECT doc_id, 'everything' FROM r"""))
def subsample_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id")
    floored = sa.subsample(docs, "doc_id", 0.137, SEED).withColumn("mode", F.lit("at least one"))
    plain = sa.subsample(docs, "doc_id", 0.0715, SEED, at_least=0).withColumn("mode", F.lit("no floor"))
    whole = sa.subsample(docs, "doc_id", 1.5, SEED).withColumn("mode", F.lit("everything"))
    return floored.unionByName(plain).unionByName(whole)


@query("k_per_class", f"""
SELECT p_partkey, p_brand FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY {digest(SEED, "p_partkey")}, p_partkey) <= 50""")
def k_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return sa.k_per_class(parts, "p_brand", "p_partkey", SEED)


@query("cluster_stratified_sample", with_ctes([TOKENS, """
n AS (SELECT cluster, count(*) AS n, sum(count(*)) OVER () AS total FROM tokens GROUP BY 1)""", """
s AS (SELECT *, least(n, greatest(1, round_even(500.0::DOUBLE * (n / total), 0)))::BIGINT AS share FROM n)""", """
t AS (SELECT cluster, greatest(0, least(share, 500 - coalesce(sum(share) OVER (ORDER BY cluster
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS target FROM s)""", f"""
r AS (SELECT token_id, cluster, target, row_number() OVER (PARTITION BY cluster ORDER BY {digest(SEED, "token_id")}, token_id) AS r
      FROM tokens JOIN t USING (cluster))""", f"""
x AS (SELECT token_id, cluster, row_number() OVER (ORDER BY {digest(SEED + ":extra", "token_id")}, token_id) AS r
      FROM r WHERE r > target)"""], """
SELECT token_id, cluster FROM r WHERE r <= target
UNION ALL SELECT token_id, cluster FROM x WHERE r <= 500 - (SELECT sum(target) FROM t)"""))
def cluster_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = views.tokens(spark, sf_dir).select("token_id", "cluster")
    return sa.cluster_stratified_sample(tokens, "token_id", "cluster", 500, SEED)


@query("weighted_shard_sample", with_ctes(["""
s AS (SELECT p_brand AS shard, sum(p_size)::DOUBLE AS w FROM part GROUP BY 1)""", """
i AS (SELECT shard, sum(w) OVER (ORDER BY shard) AS high, w, sum(w) OVER () AS total FROM s)""", f"""
d AS (SELECT o_orderkey, {uniform(SEED, "o_orderkey")} AS u FROM orders)"""], """
SELECT o_orderkey, shard FROM d JOIN i ON u >= (high - w) / total AND u < high / total"""))
def weighted_shard_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = views.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("shard")).agg(F.sum("p_size").alias("weight"))
    draws = views.table(spark, sf_dir, "orders").select("o_orderkey")
    return sa.weighted_draws(draws, "o_orderkey", shards, "shard", "weight", SEED)


@query("epoch_shuffle", with_ctes([f"""
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {digest("45", "o_orderkey")}, o_orderkey) - 1 AS position FROM orders)"""], """
SELECT o_orderkey, position, position % 4 AS node, (position // 4) % 3 AS worker FROM r"""))
def epoch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.epoch_shuffle(views.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 42, 3, 4, 3)


@query("head_limit", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 64")
def head_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.head_limit(views.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 64)


@query("evenly_spaced", with_ctes(["""
r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM events)"""], """
SELECT event_id FROM r WHERE r IN (SELECT (i * (SELECT count(*) FROM events)) // 333 FROM range(333) t(i))"""))
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.evenly_spaced(views.table(spark, sf_dir, "events").select("event_id"), "event_id", 333)


_PAD = "list_concat({x}, list_transform(generate_series(1, greatest(0, 8 - len({x}))), lambda i: {x}[len({x})]))"


@query("frame_sample", with_ctes(["""
b AS (SELECT doc_id AS clip_id, (doc_id % 40) AS lo, least(n_chars - 1, doc_id % 40 + doc_id % 13 * 3) AS hi FROM documents)""", """
s AS (SELECT *, list_transform(generate_series(0, least(8, hi - lo + 1) - 1), lambda i:
         round_even(lo + i * coalesce((hi - lo) / nullif(least(8, hi - lo + 1) - 1, 0), 0), 0)::BIGINT) AS u,
       generate_series(lo, least(lo + 8, hi + 1) - 1) AS f,
       generate_series(greatest(lo, (lo + hi) // 2 - 4), least(hi + 1, greatest(lo, (lo + hi) // 2 - 4) + 8) - 1) AS c
      FROM b WHERE lo <= hi)"""], " UNION ALL ".join(
          f"SELECT clip_id, '{mode}' AS mode, array_to_string({_PAD.format(x=col)}, ',') AS frames FROM s"
          for mode, col in (("uniform", "u"), ("first", "f"), ("center", "c"))) + """
UNION ALL SELECT clip_id, mode, NULL FROM b, (VALUES ('uniform'), ('first'), ('center')) m(mode) WHERE lo > hi"""))
def frame_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = F.col("clip_id")
    ranges = views.clips(spark, sf_dir).select(
        "clip_id", (clip % 40).alias("lo"), F.least(F.col("v_len") - 1, clip % 40 + clip % 13 * 3).alias("hi"))
    modes = F.array(*[
        F.struct(F.lit(m).alias("mode"), F.array_join(F.when(F.col("lo") <= F.col("hi"), sa.frame_indices(F.col("lo"), F.col("hi"), 8, m)).cast("array<string>"), ",").alias("frames"))
        for m in ("uniform", "first", "center")])
    return ranges.select("clip_id", F.inline(modes))


@query("trial_repeat", """
SELECT doc_id AS clip_id, i AS iter_idx FROM documents, range(3) t(i)""")
def trial_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jo.repeat_trials(views.clips(spark, sf_dir).select("clip_id"), 3)


_D21 = double_list(GRID21)


@query("grid_quantize", f"""
SELECT event_id, idx, {_D21}[idx + 1] AS grid_sec FROM (
  SELECT event_id, list_position(gaps, list_min(gaps)) - 1 AS idx FROM (
    SELECT event_id, list_transform({_D21}, lambda g: abs(g - (value % 5 - 2.5))) AS gaps FROM events))""")
def grid_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = ev.grid_column(GRID21)
    e = views.table(spark, sf_dir, "events").select("event_id", jo.nearest_index(grid, F.col("value") % 5 - 2.5).alias("idx"))
    return tidy(e.withColumn("grid_sec", F.get(grid, F.col("idx").cast("int"))))
