"""Token, cluster and raster queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clipalign import views
from clipalign.catalog import query, tidy
from clipalign.catalog.ctes import TOKENS, UNIT, r6, with_ctes
from clipalign.functions import vectors
from clipalign.operators import clustering as cl, tokens as tk

FRAME_SEC = 0.01


def _channels(cluster: Column) -> list[Column]:
    """A plain colour per cluster, where a query needs one that SQL can repeat."""
    return [((cluster + 1) / 6).alias("r"), ((cluster * 2) % 5 / 5).alias("g"), (F.lit(1.0) - cluster / 7).alias("b")]


_RGB = "(cluster + 1) / 6 AS r, (cluster * 2) % 5 / 5 AS g, 1.0::DOUBLE - cluster / 7 AS b"


def _palette(tokens: DataFrame) -> DataFrame:
    return tokens.select("cluster").distinct().select("cluster", *_channels(F.col("cluster")))


def _colored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.tokens(spark, sf_dir).select("*", *_channels(F.col("cluster")))


@query("global_token_offsets", with_ctes([TOKENS, """
c AS (SELECT video, count(*) AS token_count FROM tokens GROUP BY 1)"""], """
SELECT video, token_count, (sum(token_count) OVER (ORDER BY video) - token_count)::BIGINT AS token_start,
  (sum(token_count) OVER (ORDER BY video))::BIGINT AS token_end FROM c"""))
def global_token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.token_offsets(views.tokens(spark, sf_dir), ["video"])


@query("joint_layer_offsets", with_ctes([TOKENS, """
c AS (SELECT video, parent AS layer, count(*) AS token_count FROM tokens GROUP BY 1, 2)"""], """
SELECT video, layer, token_count, (sum(token_count) OVER (ORDER BY video, layer) - token_count)::BIGINT AS token_start,
  (sum(token_count) OVER (ORDER BY video, layer))::BIGINT AS token_end FROM c"""))
def joint_layer_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.token_offsets(views.tokens(spark, sf_dir).withColumnRenamed("parent", "layer"), ["video", "layer"])


@query("token_metadata_table", with_ctes([TOKENS, f"""
g AS (SELECT *, row_number() OVER (ORDER BY video, token_id) - 1 AS gid, dense_rank() OVER (ORDER BY video) - 1 AS vi,
        row_number() OVER (PARTITION BY video ORDER BY token_id) - 1 AS lid, {_RGB} FROM tokens)"""], f"""
SELECT gid AS global_token_index, vi AS video_index, 'v' || video || '.mp4' AS video_name, lid AS local_token_index,
  cluster AS cluster_id, parent AS parent_cluster_id, (parent = 1)::BIGINT AS selected_for_this_stage,
  {r6("r", "color_r")}, {r6("g", "color_g")}, {r6("b", "color_b")},
  printf('#%02x%02x%02x', round_even(r * 255, 0)::INT, round_even(g * 255, 0)::INT, round_even(b * 255, 0)::INT) AS color_hex,
  f0 AS freq_bin_start, f1 AS freq_bin_end, t0 AS time_frame_start, t1 AS time_frame_end,
  {r6("t0 * 0.01::DOUBLE", "time_sec_start")}, {r6("t1 * 0.01::DOUBLE", "time_sec_end")} FROM g WHERE cluster <> -1"""))
def token_metadata_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = views.tokens(spark, sf_dir)
    colors = _palette(tokens)
    numbered = tk.global_token_ids(tokens, "video", "token_id")
    return tidy(tk.token_metadata(numbered, colors, F.col("parent") == 1, FRAME_SEC))


@query("cluster_summary", with_ctes([TOKENS], f"""
SELECT cluster AS cluster_id, {r6("(cluster + 1) / 6", "color_r")}, {r6("(cluster * 2) % 5 / 5", "color_g")},
  {r6("1.0::DOUBLE - cluster / 7", "color_b")}, printf('#%02x%02x%02x', round_even((cluster + 1) / 6 * 255, 0)::INT,
    round_even((cluster * 2) % 5 / 5 * 255, 0)::INT, round_even((1.0::DOUBLE - cluster / 7) * 255, 0)::INT) AS color_hex,
  CASE WHEN grouping(video) = 1 THEN -1 ELSE video END AS video_index,
  CASE WHEN grouping(video) = 1 THEN 'ALL' ELSE 'v' || video || '.mp4' END AS video_name, count(*) AS token_count,
  array_to_string(list_sort(list(DISTINCT parent)), ' ') AS parent_cluster_ids_present,
  min(f0) AS freq_bin_start, max(f1) AS freq_bin_end, min(t0) AS time_frame_start, max(t1) AS time_frame_end,
  {r6("min(t0) * 0.01::DOUBLE", "time_sec_start")}, {r6("max(t1) * 0.01::DOUBLE", "time_sec_end")}
FROM tokens WHERE cluster <> -1 GROUP BY GROUPING SETS ((cluster), (cluster, video))"""))
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = views.tokens(spark, sf_dir)
    return tidy(tk.cluster_summary(tokens, _palette(tokens), FRAME_SEC))


@query("cluster_members", with_ctes([TOKENS, """
r AS (SELECT cluster, token_id, (row_number() OVER (PARTITION BY cluster ORDER BY token_id) - 1) // 256 AS part FROM tokens WHERE cluster <> -1)"""], """
SELECT cluster, part, count(*) AS n, md5(string_agg(token_id, ',' ORDER BY token_id)) AS digest FROM r GROUP BY 1, 2"""))
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = tk.cluster_members(views.tokens(spark, sf_dir), "token_id", 256)
    return members.select("cluster", "part", F.size("members").cast("bigint").alias("n"),
                          F.md5(F.array_join(F.col("members").cast("array<string>"), ",")).alias("digest"))


@query("cluster_diagnostics", with_ctes([TOKENS, """
c AS (SELECT user_id % 17 AS cluster, count(*) AS n FROM events GROUP BY 1)"""], """
SELECT cluster, n, 20::BIGINT AS requested, (SELECT count(*) FROM c) AS actual, (SELECT sum(n)::BIGINT FROM c) AS tokens
FROM c ORDER BY n DESC, cluster LIMIT 12"""))
def cluster_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = views.table(spark, sf_dir, "events").select((F.col("user_id") % 17).alias("cluster"))
    return tk.cluster_diagnostics(tokens, 20)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors.l2_normalize(vectors.as_double(F.col("embedding")))
    return views.table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") * 2).cast("bigint").alias("cluster"), F.floor(F.col("vec_id") / 20).alias("video"),
        v.alias("feat"), F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y"))


POINTS = f"""{UNIT},
points AS (SELECT vec_id, target * 2 AS cluster, vec_id // 20 AS video, u, u[1] AS x, u[2] AS y FROM unit)"""


@query("cluster_centroids", with_ctes([POINTS, """
c AS (SELECT cluster, p, count(*) AS n, avg(v) AS v
      FROM (SELECT cluster, unnest(u) AS v, generate_subscripts(u, 1) AS p FROM points) GROUP BY 1, 2)"""], f"""
SELECT i AS cluster, coalesce(n, 0)::BIGINT AS n, d.p AS dim, {r6("coalesce(v, 0)", "value")}
FROM (SELECT unnest(generate_series(0, (SELECT max(cluster) FROM points))) AS i) CROSS JOIN (SELECT unnest(generate_series(1, 64)) AS p) d
LEFT JOIN c ON cluster = i AND c.p = d.p"""))
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = tk.cluster_centroids(_points(spark, sf_dir), "cluster", "feat", 64)
    return _dims(centroids, "centroid")


def _dims(df: DataFrame, vector: str) -> DataFrame:
    """A row per dimension of a vector, from 1."""
    rows = df.select(*[c for c in df.columns if c != vector], F.posexplode(vector).alias("dim", "value"))
    return tidy(rows.withColumn("dim", F.col("dim").cast("bigint") + 1))


@query("plot_medians", with_ctes([POINTS], f"""
SELECT 'cluster' AS kind, cluster AS id, {r6("median(x)", "x")}, {r6("median(y)", "y")} FROM points GROUP BY 2
UNION ALL SELECT 'video', video, {r6("median(x)")}, {r6("median(y)")} FROM points GROUP BY 2"""))
def plot_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(tk.plot_medians(_points(spark, sf_dir), ["cluster", "video"]))


@query("frame_pooled_features", with_ctes([POINTS], f"""
SELECT video, vec_id % 4 AS t, count(*) AS n, p AS dim, {r6("avg(v)", "value")}
FROM (SELECT video, vec_id, unnest(u) AS v, generate_subscripts(u, 1) AS p FROM points) GROUP BY 1, 2, p"""))
def frame_pooled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = tk.frame_pooled(_points(spark, sf_dir).withColumn("t", F.col("vec_id") % 4), ["video", "t"], "feat")
    return _dims(pooled, "pooled")


@query("token_intervals", with_ctes([TOKENS, """
c AS (SELECT token_id, video, t0 + 0.5::DOUBLE AS center FROM tokens)""", """
n AS (SELECT *, lag(center) OVER w AS p, lead(center) OVER w AS q FROM c WINDOW w AS (PARTITION BY video ORDER BY center, token_id))"""], f"""
SELECT token_id, video, {r6("center", "center")}, {r6("greatest(0, coalesce((p + center) / 2, 0))", "start_sec")},
  {r6("least(86000, coalesce((center + q) / 2, 86000))", "end_sec")} FROM n"""))
def token_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = views.tokens(spark, sf_dir).select("token_id", "video", (F.col("t0") + 0.5).alias("center"))
    return tidy(tk.token_intervals(centers, "video", "center", "token_id", F.lit(86000.0)))


@query("hold_last_value", with_ctes([TOKENS, """
m AS (SELECT video, t0 // 600 AS frame, avg(value) AS sampled FROM tokens GROUP BY 1, 2)""", """
e AS (SELECT v.video, f.frame, sampled FROM (SELECT DISTINCT video FROM tokens) v CROSS JOIN range(144) f(frame)
      LEFT JOIN m ON m.video = v.video AND m.frame = f.frame)"""], f"""
SELECT video, frame, {r6("sampled", "sampled")},
  {r6("last_value(sampled IGNORE NULLS) OVER (PARTITION BY video ORDER BY frame)", "held")} FROM e"""))
def hold_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = views.tokens(spark, sf_dir).select("video", F.floor(F.col("t0") / 600).alias("frame"), "value")
    frames = masks.select("video").distinct().withColumn(
        "frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(143).cast("bigint"))))
    return tidy(tk.hold_last(masks, frames, "video", "frame", "value"))


@query("unique_output_stems", with_ctes(["""
f AS (SELECT '/data/' || source || '/' || lang || '/clip' || (doc_id % 400) || '.v1.mp4' AS path, 'clip' || (doc_id % 400) || '.v1' AS stem, lang FROM documents)""", """
d AS (SELECT DISTINCT * FROM f)""", """
c AS (SELECT path, CASE WHEN count(*) OVER (PARTITION BY stem) = 1 THEN stem ELSE lang || '_' || stem END AS cand,
        row_number() OVER (ORDER BY path) - 1 AS idx FROM d)"""], """
SELECT path, CASE WHEN row_number() OVER (PARTITION BY cand ORDER BY idx) = 1 THEN cand ELSE cand || '_' || printf('%04d', idx) END AS output_stem FROM c"""))
def unique_output_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    files = docs.select(F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit("/clip"), F.col("doc_id") % 400,
                                 F.lit(".v1.mp4")).alias("path")).distinct()
    return tk.output_stems(files, "path")


@query("unique_root_names", with_ctes(["""
r AS (SELECT '/data/' || source || '/' || lang AS root, min(doc_id) AS position, lang FROM documents GROUP BY source, lang)"""], """
SELECT root, position, CASE WHEN n = 1 THEN lang ELSE lang || '_' || n END AS root_name
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY position) AS n FROM r)"""))
def unique_root_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = views.table(spark, sf_dir, "documents").groupBy(
        F.concat(F.lit("/data/"), "source", F.lit("/"), "lang").alias("root")).agg(F.min("doc_id").alias("position"))
    return tk.root_names(roots, "root", "position")


@query("time_band_raster", with_ctes([TOKENS, f"""
iv AS (SELECT video, t0 * 1.0::DOUBLE AS st, t1 + 250.5::DOUBLE AS en, {_RGB} FROM tokens)""", """
b AS (SELECT *, greatest(0, least(300, floor(st / 300)))::BIGINT AS b0, greatest(0, least(280, ceil(en / 300)))::BIGINT AS b1 FROM iv)""", """
x AS (SELECT video, unnest(generate_series(least(b0, 280), b1 - 1)) AS bin, r, g, b FROM b WHERE b1 > least(b0, 280))""", """
m AS (SELECT video, bin, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM x GROUP BY 1, 2)"""], f"""
SELECT v.video, f.bin, {r6("coalesce(r, 0)", "r")}, {r6("coalesce(g, 0)", "g")}, {r6("coalesce(b, 0)", "b")}, (r IS NOT NULL)::INTEGER AS coverage
FROM (SELECT DISTINCT video FROM tokens) v CROSS JOIN range(280) f(bin) LEFT JOIN m ON m.video = v.video AND m.bin = f.bin"""))
def time_band_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    intervals = _colored(spark, sf_dir).select(
        "video", F.col("t0").cast("double").alias("start_sec"), (F.col("t1") + 250.5).alias("end_sec"), "r", "g", "b")
    return tidy(tk.time_band_raster(intervals, "video", 300.0, 280))


@query("patch_raster", with_ctes([TOKENS, f"""
p AS (SELECT video, f0 // 8 AS f0, f1 // 8 AS f1, t0 // 60 AS t0, t0 // 60 + 1 + token_id % 3 AS t1, {_RGB} FROM tokens WHERE cluster >= 0)""", """
y AS (SELECT *, unnest(generate_series(f0, f1 - 1)) AS f FROM p WHERE f1 > f0)""", """
x AS (SELECT *, unnest(generate_series(t0, t1 - 1)) AS t FROM y)"""], f"""
SELECT video, f, t, {r6("avg(r)", "r")}, {r6("avg(g)", "g")}, {r6("avg(b)", "b")}, count(*) AS n FROM x GROUP BY 1, 2, 3"""))
def patch_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.floor(F.col("t0") / 60)
    patches = _colored(spark, sf_dir).select(
        "video", "cluster", "r", "g", "b", F.floor(F.col("f0") / 8).alias("f0"), F.floor(F.col("f1") / 8).alias("f1"),
        minute.alias("t0"), (minute + 1 + F.col("token_id") % 3).alias("t1"))
    return tidy(tk.patch_raster(patches, "video"))


@query("layer_token_table", with_ctes([TOKENS], f"""
SELECT row_number() OVER (PARTITION BY video, parent ORDER BY token_id) - 1 AS row, parent AS layer, cluster,
  {r6("t0 * 0.01::DOUBLE", "start_sec")}, {r6("t1 * 0.01::DOUBLE", "end_sec")}, '/media/v' || video || '.mp4' AS video_path FROM tokens"""))
def layer_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = views.tokens(spark, sf_dir).select(
        "video", F.col("parent").alias("layer"), "token_id", "cluster", (F.col("t0") * FRAME_SEC).alias("start_sec"),
        (F.col("t1") * FRAME_SEC).alias("end_sec"))
    return tidy(tk.layer_table(tokens, "video", "layer", "token_id"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 20).alias("video"), vectors.as_double(F.col("embedding")).alias("feat"),
        (F.col("vec_id") % 4).alias("parent"), F.when(F.col("vec_id") % 2 == 0, "l0").otherwise("l1").alias("layer"))


@query("standardize_pca_l2")
def standardize_pca_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = cl.standardize_pca_l2(_features(spark, sf_dir), "feat", 16)
    return tidy(embedded.select("vec_id", F.size("embedded").alias("dims"), vectors.norm(F.col("embedded")).alias("norm")))


#: Clusters of each way, and the layers that the joint way clusters together: one of them twice.
WAYS = {"global": 8, "spectral": 8, "per clip": 3, "per layer": 4, "joint layers": 6, "concat layers": 5}
JOINT_LAYERS = ["l0", "l1", "l0"]


@query("token_cluster", f"""
SELECT mode, vec_id, CASE WHEN mode = 'joint layers' AND vec_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n, true AS in_range, true AS agree,
  CASE WHEN mode = 'joint layers' THEN vec_id // 20 * 30 + vec_id % 2 * 10 WHEN mode = 'concat layers' THEN vec_id // 20 * 10 END AS start
FROM embeddings, (VALUES {", ".join(f"('{w}')" for w in WAYS)}) w(mode)""")
def token_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ways to group the tokens before clustering: together, by clip, by layer, over layers, and by spectral embedding.

    Labels differ between solvers, so a row says how often a token was labelled, whether its labels lie below the number of clusters, and
    whether those that have to agree do: of a token in a layer that is given twice, and of the layers of a concatenated window.
    """
    feats = _features(spark, sf_dir).withColumn("window", F.floor(F.col("vec_id") % 20 / 2))
    runs = {
        "global": cl.token_clusters(feats, "feat", "vec_id", WAYS["global"], 7),
        "spectral": cl.token_clusters(feats, "feat", "vec_id", WAYS["spectral"], 7, method="spectral"),
        "per clip": cl.grouped_clusters(feats, "video", "feat", "vec_id", WAYS["per clip"], "7"),
        "per layer": cl.separate_layer_clusters(feats, ["l0", "l1"], "feat", "vec_id", WAYS["per layer"], 7),
        "joint layers": cl.joint_layer_clusters(feats, JOINT_LAYERS, "feat", "vec_id", WAYS["joint layers"], 7),
        "concat layers": cl.concat_layer_clusters(feats, ["l0", "l1"], "video", "window", "feat", WAYS["concat layers"], 7),
    }
    parts = []
    for name, df in runs.items():
        alike = ["video", "window"] if name == "concat layers" else ["vec_id"]
        labels = df.groupBy(*alike).agg(
            F.collect_list("vec_id").alias("ids"), (F.min("cluster") == F.max("cluster")).alias("agree"),
            ((F.min("cluster") >= 0) & (F.max("cluster") < WAYS[name])).alias("in_range"))
        rows = labels.select(F.lit(name).alias("mode"), F.explode("ids").alias("vec_id"), "in_range", "agree")
        parts.append(rows.groupBy("mode", "vec_id", "in_range", "agree").agg(F.count(F.lit(1)).alias("n")))
    found = reduce(DataFrame.unionByName, parts)
    offsets = cl.layer_offsets(feats, "video", JOINT_LAYERS).withColumn("mode", F.lit("joint layers")).unionByName(
        cl.layer_offsets(feats, "video", ["l0", "l1"], shared=True).withColumn("mode", F.lit("concat layers")))
    starts = offsets.groupBy("mode", "video", "layer").agg(F.min("start").alias("start"))
    return found.join(feats.select("vec_id", "video", "layer"), "vec_id").join(starts, ["mode", "video", "layer"], "left").select(
        "mode", "vec_id", "n", "in_range", "agree", "start")


@query("recursive_cluster")
def recursive_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.recursive_clusters(_features(spark, sf_dir), [1, 3], "feat", "vec_id", 4, 7).select("vec_id", "parent", "cluster")


@query("pca_colors")
def pca_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(cl.cluster_colors(_points(spark, sf_dir), "cluster", "feat"))


@query("point_table")
def point_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).drop("x", "y")
    return tidy(cl.point_table(points, "vec_id", "cluster", "feat", 200, "7"))
