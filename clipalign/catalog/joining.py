"""Score comparison, pooling, token-cache and run-matching queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign import views
from clipalign.catalog import query, tidy
from clipalign.catalog.ctes import TOKENS, r6, with_ctes
from clipalign.operators import joining as jo, ranking


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Score per customer from even and odd orders, under different folders, and a highlight list."""
    orders = views.table(spark, sf_dir, "orders")

    def half(parity: int, folder: str) -> DataFrame:
        path = F.concat(F.lit(f"/{folder}/clip."), F.col("o_custkey"), F.lit(".mp4"))
        return orders.where(F.col("o_orderkey") % 2 == parity).groupBy(path.alias("video")).agg(
            F.round(F.max("o_totalprice") / 10000, 6).alias("diag_margin"))

    marks = orders.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("clip."), F.col("o_custkey")).alias("video_id"))
    return half(0, "before"), half(1, "after"), marks


COMPARED = """
b AS (SELECT 'clip.' || o_custkey AS video_id, round(max(o_totalprice) / 10000, 6) AS diag_margin_before FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
a AS (SELECT 'clip.' || o_custkey AS video_id, round(max(o_totalprice) / 10000, 6) AS diag_margin_after FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
cmp AS (SELECT *, diag_margin_after - diag_margin_before AS delta, abs(diag_margin_after - diag_margin_before) AS abs_delta,
          video_id IN (SELECT 'clip.' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS is_highlight FROM b JOIN a USING (video_id))"""
_CMP = "video_id, is_highlight, " + ", ".join(r6(c, c) for c in ("diag_margin_before", "diag_margin_after", "delta", "abs_delta"))


@query("before_after_join", with_ctes([COMPARED], f"SELECT {_CMP} FROM cmp"))
def before_after_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after, marks = _scores(spark, sf_dir)
    return tidy(ranking.compare_scores(before, after, marks, "video", "diag_margin").orderBy("delta"))


@query("before_after_means", with_ctes([COMPARED], " UNION ALL ".join(
    f"SELECT '{scope}' AS scope, count(*) AS n, {r6('avg(diag_margin_before)', 'mean_before')}, "
    f"{r6('avg(diag_margin_after)', 'mean_after')}, {r6('avg(delta)', 'mean_delta')} FROM cmp WHERE {cond}"
    for scope, cond in (("all", "true"), ("highlighted", "is_highlight")))))
def before_after_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after, marks = _scores(spark, sf_dir)
    return tidy(ranking.comparison_means(ranking.compare_scores(before, after, marks, "video", "diag_margin"), "diag_margin"))


@query("before_after_top", with_ctes([COMPARED], f"SELECT {_CMP} FROM cmp ORDER BY cmp.abs_delta DESC, video_id LIMIT 10"))
def before_after_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after, marks = _scores(spark, sf_dir)
    return tidy(ranking.largest_changes(ranking.compare_scores(before, after, marks, "video", "diag_margin")))


@query("interval_pool_join", with_ctes([TOKENS, """
c AS (SELECT video, token_id, t0 + 0.5::DOUBLE AS center, value FROM tokens)""", """
w AS (SELECT video, k AS win, k * 1200.0::DOUBLE AS st, least(86400, k * 1200.0::DOUBLE + 3000) AS en
      FROM (SELECT DISTINCT video FROM tokens), range(70) t(k))""", """
p AS (SELECT w.video, w.win, w.st, w.en, count(token_id) AS n_tokens, avg(value) AS pooled
      FROM w LEFT JOIN c ON c.video = w.video AND c.center >= w.st AND c.center < w.en GROUP BY 1, 2, 3, 4)""", """
f AS (SELECT p.video, p.win, (SELECT first(c.value ORDER BY abs(c.center - (p.st + p.en) / 2), c.center, c.token_id)
                              FROM c WHERE c.video = p.video) AS near FROM p WHERE n_tokens = 0)"""], f"""
SELECT p.video, p.win, {r6("st", "start_sec")}, {r6("en", "end_sec")}, n_tokens, {r6("coalesce(pooled, near)", "pooled")}
FROM p LEFT JOIN f ON f.video = p.video AND f.win = p.win"""))
def interval_pool_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = views.tokens(spark, sf_dir).select("token_id", "video", (F.col("t0") + 0.5).alias("center"), "value")
    durations = tokens.select("video").distinct().withColumn("duration_sec", F.lit(86400.0))
    return tidy(jo.pool_windows(tokens, durations, 3000.0, 1200.0))


@query("token_cache_compare", with_ctes([TOKENS, """
cur AS (SELECT token_id, video, t0, t1 + (CASE WHEN token_id % 100 = 7 THEN 1 ELSE 0 END) AS t1, f0, f1,
               CASE WHEN token_id % 250 = 3 THEN 'other' ELSE 'v' || video END AS name FROM tokens WHERE token_id % 500 <> 9)""", """
j AS (SELECT t.token_id AS l, c.token_id AS r, t.t1 <> c.t1 AS dc, 'v' || t.video <> c.name AS dn FROM tokens t FULL JOIN cur c USING (token_id))"""], """
SELECT 'token count' AS "check", count(*) AS n_different, CASE WHEN count(*) = 0 THEN 'ok' ELSE 'error' END AS severity FROM j WHERE l IS NULL OR r IS NULL
UNION ALL SELECT 'coordinates', count(*), CASE WHEN count(*) = 0 THEN 'ok' ELSE 'error' END FROM j WHERE dc
UNION ALL SELECT 'video ids', 0, 'ok'
UNION ALL SELECT 'video names', count(*), CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warning' END FROM j WHERE dn"""))
def token_cache_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = views.tokens(spark, sf_dir).withColumn("name", F.concat(F.lit("v"), F.col("video")))
    shifted = F.col("t1") + (F.col("token_id") % 100 == 7).cast("int")
    current = cached.where("token_id % 500 <> 9").withColumn("t1", shifted).withColumn(
        "name", F.when(F.col("token_id") % 250 == 3, "other").otherwise(F.col("name")))
    checks = {"coordinates": ["f0", "f1", "t0", "t1"], "video ids": ["video"], "video names": ["name"]}
    return jo.compare_token_tables(cached, current, "token_id", checks, warnings=["video names"])


@query("parent_cache_match", with_ctes(["""
l AS (SELECT l_orderkey AS run, list(l_suppkey % 40 ORDER BY l_linenumber, l_suppkey, l_partkey) AS items FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS p FROM lineitem) GROUP BY 1)""", """
r AS (SELECT l.run, items, o_orderstatus AS seed, o_orderkey AS mtime FROM l JOIN orders ON o_orderkey = run)""", """
k AS (SELECT items, seed, count(*) AS n, arg_max(run, mtime) AS newest FROM r WHERE run % 10 <> 0 GROUP BY 1, 2)"""], """
SELECT r.run, coalesce(n, 0) AS n_candidates, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status,
  CASE WHEN n = 1 THEN newest END AS parent_run
FROM r LEFT JOIN k ON k.items = r.items AND k.seed = r.seed WHERE r.run % 10 = 0"""))
def parent_cache_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    items = views.table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")  # an order has few lines
    listed = items.select(
        F.col("l_orderkey").alias("run"), F.row_number().over(order).alias("position"), (F.col("l_suppkey") % 40).alias("item"))
    runs = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("seed"), F.col("o_orderkey").alias("mtime"))
    return jo.match_parent_runs(runs.where("run % 10 = 0"), runs.where("run % 10 <> 0"), listed, ["seed"])
