"""Corpus curation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign import views
from clipalign.catalog import query, tidy
from clipalign.catalog.ctes import r6, with_ctes
from clipalign.operators import curation as cu, ranking


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip metadata: eleven-character video id, start second, label and split."""
    docs = views.table(spark, sf_dir, "documents")
    meta = docs.select(
        "doc_id", F.lpad(F.col("doc_id").cast("string"), 11, "v").alias("video_id"),
        (F.col("doc_id") % 90).alias("start_sec"), F.concat("lang", F.lit("-"), F.col("doc_id") % 7).alias("label"),
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"), "n_chars")
    return meta.withColumn("clip_id", cu.clip_key(F.col("video_id"), F.col("start_sec")))


CORPUS = """
corpus AS (
  SELECT doc_id, lpad(doc_id::VARCHAR, 11, 'v') AS video_id, doc_id % 90 AS start_sec, lang || '-' || (doc_id % 7) AS label,
    CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, n_chars,
    lpad(doc_id::VARCHAR, 11, 'v') || '_' || (doc_id % 90 * 1000) || '_' || ((doc_id % 90 + 10) * 1000) AS clip_id
  FROM documents
)"""


def _lists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two block lists: toxic clips, and low-quality clips whose lines carry the file suffix."""
    corpus = _corpus(spark, sf_dir).select("doc_id", "clip_id")
    labels = views.table(spark, sf_dir, "labels")
    toxic = corpus.join(labels.where("toxic = 1"), "doc_id").select("clip_id")
    poor = corpus.join(labels.where("quality = 0"), "doc_id").select(F.concat("clip_id", F.lit(".mp4")).alias("clip_id"))
    odd = corpus.join(labels.where("quality = 0"), "doc_id").where("doc_id % 2 = 1").select("clip_id")
    return {"toxic": toxic, "poor": poor, "odd": odd}


LISTS = """
blocked AS (
  SELECT clip_id, 'toxic' AS list_name FROM corpus JOIN labels USING (doc_id) WHERE toxic = 1
  UNION ALL SELECT clip_id || '.mp4', 'poor' FROM corpus JOIN labels USING (doc_id) WHERE quality = 0
  UNION ALL SELECT clip_id, 'odd' FROM corpus JOIN labels USING (doc_id) WHERE quality = 0 AND doc_id % 2 = 1
)"""


@query("clip_key_build", with_ctes([CORPUS], """
SELECT doc_id, clip_id,
  ['unbalanced_train_segments', 'balanced_train_segments', 'eval_segments'][doc_id % 3 + 1] || '/' || video_id || '_'
    || trunc((start_sec + 0.25::DOUBLE) * 1000)::BIGINT || '_' || trunc((start_sec + n_chars / 100) * 1000)::BIGINT AS long_key
FROM corpus"""))
def clip_key_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*[F.lit(f) for f in cu.FOLDER_NAMES]), (F.col("doc_id") % 3 + 1).cast("int"))
    long_id = cu.expand_folder(F.concat_ws("/", folder, F.col("video_id")))
    key = cu.clip_key(long_id, F.col("start_sec") + 0.25, F.col("start_sec") + F.col("n_chars") / 100)
    return _corpus(spark, sf_dir).select("doc_id", "clip_id", key.alias("long_key"))


@query("clip_key_parse", with_ctes([CORPUS], """
SELECT doc_id, video_id, 'shard-' || (doc_id % 16) || '.tar' AS shard FROM corpus"""))
def clip_key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    path = F.concat(F.lit("/data/clips/shard-"), F.col("doc_id") % 16, F.lit(".tar::x/"), F.col("clip_id"), F.lit(".mp4"))
    return corpus.select("doc_id", *[c.alias(n) for n, c in cu.parse_clip_key(path).items()])


@query("blocklist_filter", with_ctes([CORPUS, LISTS], """
SELECT doc_id, 'as listed' AS mode FROM corpus WHERE clip_id NOT IN (SELECT clip_id FROM blocked)
UNION ALL
SELECT doc_id, 'normalized' FROM corpus WHERE clip_id NOT IN (SELECT regexp_replace(clip_id, '\\.mp4$', '') FROM blocked)"""))
def blocklist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, blocked = _corpus(spark, sf_dir), cu.blocklist_union(_lists(spark, sf_dir), "clip_id")
    plain = cu.remove_blocked(corpus, blocked, "clip_id").withColumn("mode", F.lit("as listed"))
    normal = cu.remove_blocked(corpus, blocked, "clip_id", normalize=True).withColumn("mode", F.lit("normalized"))
    return plain.unionByName(normal).select("doc_id", "mode")


@query("blocklist_union", with_ctes([CORPUS, LISTS], """
SELECT clip_id, count(DISTINCT list_name) AS n_lists FROM blocked GROUP BY 1"""))
def blocklist_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.blocklist_union(_lists(spark, sf_dir), "clip_id")


@query("split_intersection", with_ctes([CORPUS], """
SELECT clip_id FROM corpus WHERE split = 'test' INTERSECT
SELECT clip_id FROM corpus JOIN labels USING (doc_id) WHERE quality = 1"""))
def split_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    there = corpus.join(views.table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")
    return cu.keep_split(there.select("clip_id"), corpus.where("split = 'test'"), "clip_id")


@query("availability_audit", with_ctes([CORPUS], """
SELECT coalesce(split, '') AS split, CASE WHEN split IS NULL THEN 'unlisted' WHEN a IS NULL THEN 'missing' ELSE 'present' END AS status,
  count(*) AS n
FROM corpus FULL JOIN (
  SELECT clip_id AS a FROM corpus JOIN labels USING (doc_id) UNION ALL SELECT 'extra' || clip_id FROM corpus WHERE doc_id % 50 = 0
) ON clip_id = a GROUP BY 1, 2"""))
def availability_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    there = corpus.join(views.table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("clip_id")
    extra = corpus.where("doc_id % 50 = 0").select(F.concat(F.lit("extra"), "clip_id").alias("clip_id"))
    return cu.availability_audit(corpus, there.unionByName(extra), "clip_id", "split")


@query("label_index", with_ctes([CORPUS], """
SELECT doc_id, label, dense_rank() OVER (ORDER BY label) - 1 AS target FROM corpus"""))
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.with_label_ids(_corpus(spark, sf_dir), "label").select("doc_id", "label", "target")


FLAGS = """
flags AS (SELECT DISTINCT p_brand AS label, CASE WHEN length(p_brand) = 8 THEN 'y' ELSE 'n' END AS is_sparse FROM part)"""


def _flags(parts: DataFrame) -> DataFrame:
    return parts.select(
        F.col("p_brand").alias("label"), F.when(F.length("p_brand") == 8, "y").otherwise("n").alias("is_sparse")).distinct()


@query("sparse_class_reindex", with_ctes([FLAGS, """
ids AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS target FROM flags WHERE is_sparse = 'y')"""], """
SELECT p_partkey, label, target FROM part JOIN ids ON label = p_brand WHERE p_size > 10"""))
def sparse_class_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part")
    clips = parts.where("p_size > 10").select("p_partkey", F.col("p_brand").alias("label"))
    return cu.reindex_flagged(clips, _flags(parts), "label", "is_sparse").select("p_partkey", "label", "target")


@query("class_coverage_check", """
SELECT DISTINCT p_brand || '/' || p_type || '/' || p_size AS label FROM part WHERE p_brand || '/' || p_type || '/' || p_size NOT IN
  (SELECT p_brand || '/' || p_type || '/' || p_size FROM part WHERE p_partkey % 2 = 0)""")
def class_coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part")
    label = F.concat_ws("/", "p_brand", "p_type", "p_size").alias("label")
    return cu.uncovered_classes(parts.where("p_partkey % 2 = 0").select(label), parts.select(label), "label")


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = views.table(spark, sf_dir, "labels")
    repeats = labels.unionByName(labels.where("doc_id % 29 = 0"))
    return repeats.select(
        F.lpad(F.col("doc_id").cast("string"), 11, "v").alias("video_id"),
        (((F.col("doc_id") * 37) % 401 - 200) / 100).alias("offset_sec"),
        ((F.col("doc_id") % 50) / 10).alias("v_start_i_sec"), F.col("quality").cast("bigint").alias("is_sync"))


@query("attach_fixed_offsets", with_ctes([CORPUS, """
dup AS (SELECT * FROM labels UNION ALL SELECT * FROM labels WHERE doc_id % 29 = 0)""", """
o AS (SELECT doc_id, count(*) AS n_offsets, any_value(quality) AS q FROM dup GROUP BY 1)"""], f"""
SELECT video_id, n_offsets, {r6("CASE WHEN n_offsets = 1 THEN ((doc_id * 37) % 401 - 200) / 100 END", "offset_sec")},
  {r6("CASE WHEN n_offsets = 1 THEN doc_id % 50 / 10 END", "v_start_i_sec")}
FROM corpus JOIN o USING (doc_id) WHERE q = 1"""))
def attach_fixed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = cu.attach_fixed_offsets(_corpus(spark, sf_dir), _offsets(spark, sf_dir), "video_id", strict=False)
    return tidy(joined.select("video_id", "n_offsets", "offset_sec", "v_start_i_sec"))


@query("strict_rate_check", f"""
SELECT event_id, 'fps' AS "check", {r6("25 + (event_id % 5) / 2500", "value")}, 25.0::DOUBLE AS expected FROM events WHERE event_id % 5 > 2
UNION ALL SELECT event_id, 'rate', {r6("16000 + user_id % 3")}, 16000.0::DOUBLE FROM events WHERE user_id % 3 > 0""")
def strict_rate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = views.table(spark, sf_dir, "events").select(
        "event_id", (F.lit(25) + (F.col("event_id") % 5) / 2500).alias("fps"), (F.lit(16000) + F.col("user_id") % 3).alias("rate"))
    return tidy(cu.rate_violations(clips, {"fps": 25.0, "rate": 16000.0}))


@query("needs_reencode", """
SELECT p_partkey, (round_even(24 + p_size / 25, 0) <> 25 OR (CASE WHEN p_size % 2 = 0 THEN 16000 ELSE 44100 END) <> 16000
  OR least(200 + p_size, 256) <> 248) AS needs FROM part""")
def needs_reencode(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rate = F.when(size % 2 == 0, 16000).otherwise(44100)
    needs = cu.needs_reencode(F.lit(24) + size / 25, rate, F.lit(200) + size, F.lit(256), 25, 16000, 248)
    return views.table(spark, sf_dir, "part").select("p_partkey", needs.alias("needs"))


@query("resolve_duration", with_ctes(["""
c AS (SELECT l_orderkey, l_linenumber, [CASE WHEN l_linenumber = 1 THEN 'nan'::DOUBLE ELSE l_quantity END,
        CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity + l_discount * 5 END, l_tax * 0 - 1, l_quantity - l_tax,
        CASE WHEN l_linenumber = 3 THEN 'inf'::DOUBLE ELSE 0 END] AS c FROM lineitem)""", """
v AS (SELECT l_orderkey, l_linenumber, list_filter(c, lambda x: x IS NOT NULL AND NOT isnan(x) AND x > 0 AND x < 'inf'::DOUBLE) AS v FROM c)"""], f"""
SELECT l_orderkey, l_linenumber, {r6("list_max(v)", "duration_sec")}, list_max(v) - list_min(v) > 0.25 AS disagrees,
  {r6("least(list_max(v), CASE WHEN l_linenumber % 2 = 0 THEN 20 END)", "capped")} FROM v"""))
def resolve_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, qty = F.col("l_linenumber"), F.col("l_quantity")
    found = cu.resolve_duration([
        F.when(line == 1, F.lit(float("nan"))).otherwise(qty), F.when(line != 2, qty + F.col("l_discount") * 5),
        F.lit(-1.0), qty - F.col("l_tax"), F.when(line == 3, F.lit(float("inf"))).otherwise(0.0)])
    items = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in found.items()])
    cap = F.when(line % 2 == 0, F.lit(20.0))
    return tidy(items.withColumn("capped", cu.effective_duration(F.col("duration_sec"), cap)))


@query("effective_duration", f"""
SELECT clip_id, {r6("least(v_len / 25, CASE WHEN clip_id % 3 <> 0 THEN 60 END)", "duration_sec")}
FROM (SELECT doc_id AS clip_id, n_chars AS v_len FROM documents)""")
def effective_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = F.when(F.col("clip_id") % 3 != 0, F.lit(60.0))
    return tidy(views.clips(spark, sf_dir).select(
        "clip_id", cu.effective_duration(F.col("v_len") / F.col("v_fps"), cap).alias("duration_sec")))


@query("multilabel_explode", """
SELECT doc_id, t AS class_id, n_name AS class_name
FROM (SELECT doc_id, unnest([doc_id % 5, (doc_id * 3) % 7 + 5, doc_id % 11 + 12]) AS t FROM documents) JOIN nation ON n_nationkey = t""")
def multilabel_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    clips = views.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws(",", *[c.cast("string") for c in (doc % 5, (doc * 3) % 7 + 5, doc % 11 + 12)]).alias("targets"))
    names = views.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("class_id"), F.col("n_name").alias("class_name"))
    return cu.explode_labels(clips, "targets", names, "class_id").select("doc_id", "class_id", "class_name")


@query("highlight_flag", with_ctes([CORPUS], """
SELECT video_id, video_id IN (SELECT video_id FROM corpus JOIN labels USING (doc_id) WHERE quality = 1) AS is_highlight FROM corpus"""))
def highlight_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    chosen = corpus.join(views.table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")
    return ranking.mark_highlighted(corpus.select("video_id"), chosen, "video_id")


@query("dataset_size", with_ctes(["""
s AS (SELECT source AS dataset, 'shard-' || (doc_id % 8) || '.tar' AS shard, count(*) AS size FROM documents GROUP BY 1, 2)"""], """
SELECT dataset, CASE WHEN dataset LIKE '%1' THEN 777 WHEN count(*) FILTER (dataset LIKE '%2' AND shard = 'shard-2.tar') > 0 THEN NULL ELSE sum(size) END::BIGINT AS total_size,
  count(*) AS num_shards, count(*) FILTER (dataset LIKE '%2' AND shard = 'shard-2.tar') AS num_unlisted
FROM s WHERE shard <> 'shard-3.tar' GROUP BY 1"""))
def dataset_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = views.table(spark, sf_dir, "documents").groupBy(
        F.col("source").alias("dataset"), F.concat(F.lit("shard-"), F.col("doc_id") % 8, F.lit(".tar")).alias("shard")
    ).agg(F.count(F.lit(1)).alias("size"))
    # one data set in ten has only a stated length, one in ten leaves a shard out of its sizes
    known = shards.where(~F.col("dataset").endswith("1") & ~(F.col("dataset").endswith("2") & (F.col("shard") == "shard-2.tar")))
    sizes = known.groupBy("dataset").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("shard", "size")))).alias("sizes_json"))
    stated = shards.select("dataset").distinct().withColumn("stated", F.lit(777).cast("bigint"))
    return cu.dataset_sizes(shards.where("shard <> 'shard-3.tar'").select("dataset", "shard"), sizes, stated)


@query("manifest_except", with_ctes([CORPUS], """
SELECT 'train without valid' AS what, video_id AS id FROM (
  SELECT video_id FROM corpus WHERE split = 'train' EXCEPT SELECT video_id FROM corpus JOIN labels USING (doc_id) WHERE quality = 1)
UNION ALL SELECT 'unknown cluster', c FROM (SELECT DISTINCT label AS c FROM corpus EXCEPT SELECT label FROM corpus WHERE doc_id % 3 = 0 AND doc_id % 7 < 4)"""))
def manifest_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    valid = corpus.join(views.table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")
    rest = cu.ids_without(corpus.where("split = 'train'").select("video_id"), valid.select("video_id"))
    unknown = cu.ids_without(corpus.select("label"), corpus.where("doc_id % 3 = 0 and doc_id % 7 < 4").select("label"))
    return rest.select(F.lit("train without valid").alias("what"), F.col("video_id").alias("id")).unionByName(
        unknown.select(F.lit("unknown cluster").alias("what"), F.col("label").alias("id")))
