"""Similarity, retrieval, loss and zero-shot queries over segment embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign import views
from clipalign.catalog import query, tidy
from clipalign.catalog.ctes import CROSS_MODAL, SEGMENTS, r6, with_ctes
from clipalign.functions import vectors
from clipalign.operators import losses, ranking, similarity as sim, text

N_SEGMENTS = 10
BATCH = 64
WIDTH = 4
SCALE = 0.07
CLIP_FACTOR = 10.0


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.segments(spark, sf_dir)


def _with_teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of each vector, normalised, stands in for a teacher's features."""
    half = vectors.l2_normalize(F.slice("feat", 1, 32))
    unit = vectors.l2_normalize(F.col("feat"))
    return _segments(spark, sf_dir).withColumn("teacher", half).withColumn("feat", unit)


@query("l2_normalize", with_ctes(["""
x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 5)) AS v FROM embeddings)""", """
n AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS u,
             sqrt(list_inner_product(v, v)) AS norm FROM x)"""], f"""
SELECT vec_id, {r6("norm", "norm")}, {r6("u[1]", "first")}, {r6("list_sum(u)", "total")} FROM n"""))
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings")
    scaled = F.transform(vectors.as_double(F.col("embedding")), lambda x: x * (F.col("vec_id") % 5))
    v = e.select("vec_id", scaled.alias("v")).withColumn("u", vectors.l2_normalize(F.col("v")))
    return tidy(v.select("vec_id", vectors.norm(F.col("v")).alias("norm"), F.get("u", F.lit(0)).alias("first"),
                         vectors.total(F.col("u")).alias("total")))


@query("similarity_matrices", with_ctes([SEGMENTS], f"""
SELECT r.video, 0::BIGINT AS chunk, r.modality || '2' || c.modality AS kind, r.seg AS row, c.seg AS col,
       {r6("list_inner_product(r.u, c.u) / 0.07", "sim")}
FROM segs r JOIN segs c USING (video)"""))
def similarity_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(sim.similarity_matrices(_segments(spark, sf_dir), N_SEGMENTS, SCALE))


NEAREST = 5


@query("corpus_similarity", """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'v' ELSE 'a' END AS modality,
         list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
p AS (
  SELECT q.vec_id AS segment, q.modality || '2' || o.modality AS kind, o.vec_id AS partner, round(list_inner_product(q.u, o.u), 9) AS sim
  FROM e q JOIN e o ON q.vec_id <> o.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY segment, kind ORDER BY sim DESC, partner) AS rank FROM p)
SELECT segment, kind, rank, partner, round(sim, 6) AS sim FROM r WHERE rank <= """ + str(NEAREST))
def corpus_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments with an id divisible by 100 against those of all clips: the best partners of each modality."""
    vec = F.col("vec_id")
    segments = views.table(spark, sf_dir, "embeddings").select(
        vec.alias("segment"), F.when(vec % 2 == 0, "v").otherwise("a").alias("modality"), F.col("embedding").alias("feat"))
    return tidy(sim.nearest_segments(segments, F.col("segment") % 100 == 0, NEAREST))


@query("row_minmax", with_ctes([SEGMENTS, CROSS_MODAL], f"""
SELECT video, 0::BIGINT AS chunk, row, col, {r6("sim", "sim")},
  {r6("(sim - min(sim) OVER w) / greatest(max(sim) OVER w - min(sim) OVER w, 1e-12)", "scaled")}
FROM cm WINDOW w AS (PARTITION BY video, row)"""))
def row_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sim.cross_modal(_segments(spark, sf_dir), N_SEGMENTS)
    return tidy(sim.row_minmax(cells, ["video", "chunk", "row"]))


@query("row_softmax", with_ctes([SEGMENTS, CROSS_MODAL, """
e AS (SELECT *, exp(sim - max(sim) OVER (PARTITION BY video, row)) AS e FROM cm)"""], f"""
SELECT video, 0::BIGINT AS chunk, row, col, {r6("sim", "sim")}, {r6("e / sum(e) OVER (PARTITION BY video, row)", "prob")}
FROM e"""))
def row_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sim.cross_modal(_segments(spark, sf_dir), N_SEGMENTS)
    return tidy(sim.row_softmax(cells, ["video", "chunk", "row"]))


ALIGNMENT = """
al AS (
  SELECT video, row, max(sim) FILTER (row = col) AS diag, max(sim) FILTER (row <> col) AS rival,
         arg_max(col, sim) AS best, sum(exp((sim - 1) / 0.07)) AS mass,
         sum(exp((sim - 1) / 0.07)) FILTER (row = col) AS own
  FROM cm GROUP BY 1, 2
),
scores AS (
  SELECT video, 0::BIGINT AS chunk, avg(diag - coalesce(rival, 0)) AS diag_margin, avg(own / mass) AS diag_prob,
         avg((best = row)::INT) AS row_acc, avg(diag) AS diag_mean, count(*) AS n_segments
  FROM al GROUP BY 1
)"""
_SCORES = ["diag_margin", "diag_prob", "row_acc", "diag_mean"]


@query("alignment_scores", with_ctes([SEGMENTS, CROSS_MODAL, ALIGNMENT],
       "SELECT video, chunk, " + ", ".join(r6(c, c) for c in _SCORES) + ", n_segments FROM scores"))
def alignment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(sim.alignment_scores(_segments(spark, sf_dir), N_SEGMENTS))


@query("rank_clips", with_ctes([SEGMENTS, CROSS_MODAL, ALIGNMENT, """
s AS (SELECT *, round(diag_margin, 6) AS score FROM scores)"""], """
SELECT row_number() OVER (ORDER BY score DESC, 'clip-' || lpad(video::VARCHAR, 12, '0') || '.mp4') AS rank,
  'clip-' || lpad(video::VARCHAR, 12, '0') || '.mp4' AS video,
  'clip-' || lpad(video::VARCHAR, 12, '0') || '_' || row_number() OVER (ORDER BY score DESC, video)
    || '_similaritymatrix' AS plot_stem, 'diag_margin' AS rank_metric, """
       + ", ".join(r6(c, c) for c in _SCORES) + ", n_segments FROM s"))
def rank_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = sim.alignment_scores(_segments(spark, sf_dir), N_SEGMENTS)
    named = scores.withColumn(
        "video", F.concat(F.lit("clip-"), F.lpad(F.col("video").cast("string"), 12, "0"), F.lit(".mp4")))
    return ranking.rank_clips(tidy(named), "diag_margin", "video").drop("chunk")


@query("shifted_window_retrieval", with_ctes([SEGMENTS, CROSS_MODAL, """
w AS (SELECT *, sum(sim) OVER x AS score, count(*) OVER x AS full_n FROM cm
      WINDOW x AS (PARTITION BY video, row - col ORDER BY row ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))""", """
f AS (SELECT * FROM w WHERE full_n = 4)""", """
a AS (SELECT video, row, arg_max(col, score) AS hit FROM f GROUP BY 1, 2)""", """
v AS (SELECT video, col, arg_max(row, score) AS hit FROM f GROUP BY 1, 2)""", """
pa AS (SELECT video, avg((hit = row)::INT) AS precision_a FROM a GROUP BY 1)""", """
pv AS (SELECT video, avg((hit = col)::INT) AS precision_v FROM v GROUP BY 1)"""], f"""
SELECT video, 0::BIGINT AS chunk, {r6("precision_a", "precision_a")}, {r6("precision_v", "precision_v")},
  {r6("(precision_a + precision_v) / 2", "precision")} FROM pa JOIN pv USING (video)"""))
def shifted_window_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows are visual and columns audio, so the side named "a" finds the best audio window of a visual one
    return tidy(sim.shifted_window_retrieval(_segments(spark, sf_dir), N_SEGMENTS, WIDTH))


PAIR_CELLS = """
pc AS (
  SELECT v.pair // 64 AS batch, v.pair AS row, a.pair AS col, list_inner_product(v.u, a.u) AS sim,
         list_inner_product(v.h, a.h) AS tsim
  FROM teach v JOIN teach a ON v.pair // 64 = a.pair // 64 AND v.modality = 'v' AND a.modality = 'a'
),
sides AS (
  SELECT batch, 'v2a' AS side, row AS query, col AS item, sim, tsim FROM pc
  UNION ALL SELECT batch, 'a2v', col, row, sim, tsim FROM pc
)"""
TEACH = """
teach AS (
  SELECT *, list_transform(u[1:32], lambda x: x / greatest(sqrt(list_inner_product(u[1:32], u[1:32])), 1e-12)) AS h
  FROM segs
)"""


def _unit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).withColumn("feat", vectors.l2_normalize(F.col("feat")))


@query("retrieval_metrics", with_ctes([SEGMENTS, TEACH, PAIR_CELLS, """
own AS (SELECT batch, side, query, sim AS own FROM sides WHERE query = item)""", """
rk AS (SELECT s.batch, s.side, s.query,
         count(*) FILTER (sim > own OR (sim = own AND item < s.query)) AS rank
       FROM sides s JOIN own o ON o.batch = s.batch AND o.side = s.side AND o.query = s.query GROUP BY 1, 2, 3)"""], f"""
SELECT batch, side AS direction, {r6("avg(rank) + 1", "mean_rank")}, (floor(median(rank)) + 1)::BIGINT AS median_rank,
  {r6("avg((rank < 1)::INT)", "recall_at_1")}, {r6("avg((rank < 5)::INT)", "recall_at_5")},
  {r6("avg((rank < 10)::INT)", "recall_at_10")} FROM rk GROUP BY 1, 2"""))
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(sim.retrieval_metrics(_unit_pairs(spark, sf_dir), BATCH))


_CE = """
ce AS (SELECT batch, side, query, ln(sum(exp((sim - 1) * {f}))) + {f} - max(sim * {f}) FILTER (query = item) AS ce
       FROM sides GROUP BY 1, 2, 3)"""


@query("contrastive_loss", with_ctes([SEGMENTS, TEACH, PAIR_CELLS, _CE.format(f="(1 / 0.07::DOUBLE)"), """
ce2 AS (SELECT batch, side, query, ln(sum(exp((sim - 1) * 10.0::DOUBLE))) + 10
               - max(sim * 10.0::DOUBLE) FILTER (query = item) AS ce FROM sides GROUP BY 1, 2, 3)"""], f"""
SELECT batch, 'divided' AS form, {r6("avg(ce)", "loss")} FROM ce GROUP BY 1
UNION ALL SELECT batch, 'multiplied', {r6("avg(ce)")} FROM ce2 GROUP BY 1"""))
def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _unit_pairs(spark, sf_dir)
    divided = losses.contrastive_loss(pairs, BATCH, 1 / SCALE).withColumn("form", F.lit("divided"))
    multiplied = losses.contrastive_loss(pairs, BATCH, CLIP_FACTOR).withColumn("form", F.lit("multiplied"))
    return tidy(divided.unionByName(multiplied))


_SOFT = """
soft AS (SELECT batch, side, query, ln(sum(exp((sim - 1) * 10.0::DOUBLE))) + 10 AS mass,
           sum(exp((tsim - 1) * 10.0::DOUBLE) * sim * 10) / sum(exp((tsim - 1) * 10.0::DOUBLE)) AS guided,
           max(sim * 10.0::DOUBLE) FILTER (query = item) AS own FROM sides GROUP BY 1, 2, 3)"""


@query("soft_target_loss", with_ctes([SEGMENTS, TEACH, PAIR_CELLS, _SOFT], f"""
SELECT batch, {r6("avg(mass - (guided * 0.4 + own * 0.6))", "loss")} FROM soft GROUP BY 1"""))
def soft_target_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(losses.soft_target_loss(_with_teacher(spark, sf_dir), BATCH, CLIP_FACTOR, 0.4))


@query("distill_loss", with_ctes([SEGMENTS, TEACH, PAIR_CELLS, _SOFT], f"""
SELECT batch, {r6("avg(mass - guided)", "loss")} FROM soft GROUP BY 1"""))
def distill_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(losses.distillation_loss(_with_teacher(spark, sf_dir), BATCH, CLIP_FACTOR))


@query("multilevel_loss", with_ctes([SEGMENTS, """
p AS (SELECT 'segment' AS level, pair // 80 AS batch, pair AS id, modality, u FROM segs
      UNION ALL SELECT 'global', video // 8, video, modality,
        list_transform(w, lambda x: x / greatest(sqrt(list_inner_product(w, w)), 1e-12))
      FROM (SELECT video, modality, list(m ORDER BY pos) AS w FROM (
        SELECT video, modality, pos, avg(x) AS m
        FROM (SELECT video, modality, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM segs) GROUP BY 1, 2, 3)
        GROUP BY 1, 2))""", """
c AS (SELECT v.level, v.batch, v.id AS row, a.id AS col, list_inner_product(v.u, a.u) * 10 AS x
      FROM p v JOIN p a ON v.level = a.level AND v.batch = a.batch AND v.modality = 'v' AND a.modality = 'a')""", """
q AS (SELECT level, batch, 'v' AS side, row AS query, col AS item, x FROM c
      UNION ALL SELECT level, batch, 'a', col, row, x FROM c)""", """
r AS (SELECT level, batch, side, query, ln(sum(exp(x - 10))) + 10 - max(x) FILTER (query = item) AS ce
      FROM q GROUP BY 1, 2, 3, 4)""", """
l AS (SELECT batch, avg(ce) FILTER (level = 'segment') AS s, avg(ce) FILTER (level = 'global') AS g FROM r GROUP BY 1)"""], f"""
SELECT batch, {r6("s", "segment_loss")}, {r6("g", "global_loss")}, {r6("s * 0.5 + g * 2", "loss")} FROM l"""))
def multilevel_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(losses.multilevel_loss(_unit_pairs(spark, sf_dir), 8, N_SEGMENTS, CLIP_FACTOR, 0.5, 2.0))


@query("feature_norms", with_ctes(["""
n AS (SELECT vec_id, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)"""], f"""
SELECT vec_id, {r6("norm", "norm")}, {r6("(norm - min(norm) OVER ()) / (max(norm) OVER () - min(norm) OVER ())", "scaled")}
FROM n"""))
def feature_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings").select(
        "vec_id", vectors.as_double(F.col("embedding")).alias("feat"))
    return tidy(ranking.scaled_norms(e, "vec_id", "feat"))


@query("concat_layers", with_ctes([SEGMENTS], f"""
SELECT video, seg, p AS dim, {r6("v", "value")}
FROM (SELECT video, seg, unnest(u) AS v, generate_subscripts(u, 1) + CASE WHEN modality = 'v' THEN 64 ELSE 0 END AS p FROM segs)"""))
def concat_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = _unit_pairs(spark, sf_dir).select("video", "seg", F.col("modality").alias("layer"), "feat")
    joined = ranking.concat_layers(layers, ["video", "seg"], ["a", "v"])
    rows = joined.select("video", "seg", F.posexplode("feat").alias("dim", "value"))
    return tidy(rows.withColumn("dim", F.col("dim").cast("bigint") + 1))


@query("prompt_expand", with_ctes(["""
names AS (SELECT DISTINCT lower(p_type) || ' ' || p_brand AS name FROM part)"""], f"""
SELECT name, t.i - 1 AS template, replace(t.txt, '{{c}}', name) AS prompt
FROM names, (SELECT unnest({text.TEMPLATES!r}) AS txt, generate_subscripts({text.TEMPLATES!r}, 1) AS i) t"""))
def prompt_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.table(spark, sf_dir, "part").select(
        F.concat(F.lower("p_type"), F.lit(" "), F.col("p_brand")).alias("name")).distinct()
    return text.expand_prompts(names, "name", text.TEMPLATES)
