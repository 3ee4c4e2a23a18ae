"""Source and sink queries. Their files are written by Spark from the given tables to the shared folder first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign import views
from clipalign.catalog import query, tidy
from clipalign.catalog.ctes import HISTORY, TOKENS, r6, with_ctes
from clipalign.catalog.curation import CORPUS, LISTS, _corpus, _lists
from clipalign.catalog.evaluation import _INTEGER, _ROW_FIGURES, GRID, ROWS, _rows
from clipalign.functions import scalars
from clipalign.operators import curation as cu, evaluation as ev, tokens as tk
from clipalign.session import scratch_path
from clipalign.sources import shards as sh, tables as tb, tar_source as tar

DOCS_PER_SHARD = 128


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of tar shards from the documents: a video, a caption and for some a picture, with repeats."""
    docs = views.table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    name = F.concat(F.lit("clips/c"), scalars.padded(doc, 9))
    content = F.encode("text", "utf-8")
    entries = F.filter(F.array(
        F.struct(F.lit(0).alias("part"), F.lit("MP4").alias("ext")),
        F.when(doc % 4 != 3, F.struct(F.lit(1).alias("part"), F.lit("txt").alias("ext"))),
        F.when(doc % 3 == 0, F.struct(F.lit(2).alias("part"), F.lit("png").alias("ext"))),
        F.when(doc % 5 == 0, F.struct(F.lit(3).alias("part"), F.lit("jpg").alias("ext"))),
        F.when(doc % 7 == 0, F.struct(F.lit(4).alias("part"), F.lit("mp4").alias("ext"))),
    ), lambda e: e.isNotNull())
    listed = docs.select(doc.alias("doc_id"), name.alias("name"), content.alias("content"), F.inline(entries))
    return listed.select(
        F.concat(F.lit("shard-"), scalars.padded(F.floor(F.col("doc_id") / DOCS_PER_SHARD), 6), F.lit(".tar")).alias("shard"),
        (F.col("doc_id") * 8 + F.col("part")).alias("position"), F.concat_ws(".", "name", "ext").alias("member"), "content")


def _shard_folder(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_path(spark, "shards")
    sh.write_shards(_members(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    return folder


_SHARD = "'shard-' || printf('%06d', doc_id // 128) || '.tar'"
_CLIP = "'clips/c' || printf('%09d', doc_id)"
MEMBERS = f"""
members AS (
  SELECT doc_id, {_SHARD} AS shard, 0 AS part, {_CLIP} || '.MP4' AS member, strlen(text) AS size FROM documents
  UNION ALL SELECT doc_id, {_SHARD}, 1, {_CLIP} || '.txt', strlen(text) FROM documents WHERE doc_id % 4 <> 3
  UNION ALL SELECT doc_id, {_SHARD}, 2, {_CLIP} || '.png', strlen(text) FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, {_SHARD}, 3, {_CLIP} || '.jpg', strlen(text) FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, {_SHARD}, 4, {_CLIP} || '.mp4', strlen(text) FROM documents WHERE doc_id % 7 = 0
)"""


def _short(column: str):
    return F.regexp_extract(column, r"[^/]*$", 0).alias(column)


@query("shard_catalog", with_ctes([MEMBERS], """
SELECT DISTINCT shard AS path, 'folder' AS spec FROM members UNION ALL
SELECT DISTINCT shard, 'braces' FROM members WHERE shard BETWEEN 'shard-000001.tar' AND 'shard-000004.tar'"""))
def shard_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _shard_folder(spark, sf_dir)
    # the glob and the repeated folder name the same files again
    whole = sh.find_shards(spark, f"{folder}, {folder}/shard-*.tar,{folder}").withColumn("spec", F.lit("folder"))
    braces = sh.find_shards(spark, folder + "/shard-{1..000004}.tar").withColumn("spec", F.lit("braces"))
    return whole.unionByName(braces).select(_short("path"), "spec")


@query("tar_member_index", with_ctes([MEMBERS, """
p AS (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, part) - 1 AS position, member, size FROM members)"""], """
SELECT shard, position, member, size, shard || '::' || member AS sample_id FROM p WHERE lower(member) LIKE '%.mp4'"""))
def tar_member_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = sh.video_index(sh.find_shards(spark, _shard_folder(spark, sf_dir)))
    return index.select(_short("shard"), "position", "member", "size", F.regexp_extract("sample_id", r"[^/]*::.*$", 0).alias("sample_id"))


@query("tar_member_contents", with_ctes([MEMBERS], """
SELECT m.shard, m.member, CASE WHEN m.part = 1 THEN 'txt' ELSE 'jpg' END AS suffix, m.size, sha256(d.text) AS content_sha256
FROM members m JOIN documents d ON m.doc_id = d.doc_id WHERE m.part IN (1, 3)"""))
def tar_member_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions and one kind of picture out of all shards, found by the source and read by their places."""
    members = tar.read_members(spark, _shard_folder(spark, sf_dir)).where(F.col("suffix").isin("txt", "jpg"))
    found = tar.read_contents(members.select("shard", "member", "suffix", "size", "offset"))
    return found.select(_short("shard"), "member", "suffix", "size", F.sha2("content", 256).alias("content_sha256"))


# a second .mp4 repeats the lowered extension of the first member and so opens a sample of its own
SAMPLES = """
samples AS (
  SELECT doc_id, shard, member[1:16] AS key, (part = 4)::INT AS second, count(*) AS n_members,
    count(*) FILTER (part = 1) > 0 AS has_txt, max(member) FILTER (part = 3) AS jpg, max(member) FILTER (part = 2) AS png,
    max(member) FILTER (part = 1) AS txt
  FROM members GROUP BY 1, 2, 3, 4
)"""


@query("tar_sample_group", with_ctes([MEMBERS, SAMPLES], """
SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, second) - 1 AS sample_no, key, n_members FROM samples"""))
def tar_sample_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = sh.group_samples(sh.find_shards(spark, _shard_folder(spark, sf_dir)))
    return samples.select(_short("shard"), "sample_no", "key", F.size("members").cast("bigint").alias("n_members"))


@query("complete_sample_filter", with_ctes([MEMBERS, SAMPLES], """
SELECT shard, key, coalesce(jpg, png) AS image, txt AS text FROM samples WHERE has_txt AND coalesce(jpg, png) IS NOT NULL"""))
def complete_sample_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = sh.group_samples(sh.find_shards(spark, _shard_folder(spark, sf_dir)))
    return sh.complete_samples(samples).select(_short("shard"), "key", "image", "text")


@query("read_csv_meta", with_ctes([CORPUS], """
SELECT 'clips' AS file, video_id AS id, start_sec::VARCHAR AS a, label || ', "quoted"' AS b FROM corpus
UNION ALL SELECT 'tagged', 'eval/' || video_id, (start_sec + 0.5)::DOUBLE::VARCHAR, (doc_id % 5) || ',' || (doc_id % 7) FROM corpus
UNION ALL SELECT 'flags', n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'y' ELSE 'n' END, NULL FROM nation"""))
def read_csv_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    paths = {name: scratch_path(spark, f"meta-{name}") for name in ("clips", "tagged", "flags")}
    quoted = {"quoteAll": True, "escape": '"'}
    corpus.select("video_id", "start_sec", F.concat("label", F.lit(', "quoted"')), "split").write.options(**quoted).csv(paths["clips"])
    corpus.select(
        F.concat(F.lit("eval/"), "video_id"), F.col("start_sec") + 0.5, F.col("start_sec") + 10.5,
        F.concat_ws(",", F.col("doc_id") % 5, F.col("doc_id") % 7), F.lit("eval")).write.options(**quoted).csv(paths["tagged"])
    views.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("class"), F.when(F.col("n_nationkey") % 2 == 0, "y").otherwise("n").alias("is_sparse")
    ).write.option("sep", "\t").option("header", True).csv(paths["flags"])
    clips = tb.read_clip_meta(spark, paths["clips"]).select(
        F.lit("clips").alias("file"), F.col("video_id").alias("id"), F.col("start_sec").cast("string").alias("a"), F.col("label").alias("b"))
    tagged = tb.read_tagged_meta(spark, paths["tagged"]).select(
        F.lit("tagged").alias("file"), F.col("dir_vid").alias("id"), F.col("start_sec").cast("string").alias("a"), F.col("targets").alias("b"))
    flags = tb.read_class_flags(spark, paths["flags"]).select(
        F.lit("flags").alias("file"), F.col("class").alias("id"), F.col("is_sparse").alias("a"), F.lit(None).cast("string").alias("b"))
    return clips.unionByName(tagged).unionByName(flags)


@query("read_id_lists", with_ctes([CORPUS, LISTS], "SELECT DISTINCT clip_id, list_name FROM blocked"))
def read_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "lists")
    for name, lines in _lists(spark, sf_dir).items():
        lines.select("clip_id").write.text(f"{folder}/{name}.txt")
    read = tb.read_id_lists(spark, folder)
    return read.select("clip_id", F.regexp_extract("file_path", r"([^/]*)\.txt/", 1).alias("list_name")).distinct()


@query("read_fixed_offsets", with_ctes([CORPUS], f"""
SELECT clip_id AS path, 1 + (doc_id % 4 = 0)::BIGINT AS n_rows, doc_id % 8 <> 0 AS agrees,
  CASE WHEN doc_id % 8 <> 0 THEN {r6("((doc_id * 37) % 401 - 200) / 100")} END AS offset_sec,
  CASE WHEN doc_id % 8 <> 0 THEN {r6("(doc_id % 50) / 10")} END AS v_start_i_sec FROM corpus"""))
def read_fixed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    offset, start = ((F.col("doc_id") * 37) % 401 - 200) / 100, (F.col("doc_id") % 50) / 10
    folder = scratch_path(spark, "offsets")
    paths = {s: f"{folder}/{tb.fixed_offset_name(s, 21, 5.0, -2.0, 2.0)}" for s in ("valid", "test")}
    listed = corpus.select(F.col("clip_id").alias("path"), offset.alias("offset_sec"), start.alias("vstart_sec"), "doc_id")
    listed.drop("doc_id").write.option("header", True).csv(paths["test"])
    # every fourth clip is in both splits, and half of those disagree
    again = listed.where("doc_id % 4 = 0").withColumn("vstart_sec", F.col("vstart_sec") + (F.col("doc_id") % 8 == 0).cast("int"))
    again.drop("doc_id").write.option("header", True).csv(paths["valid"])
    return tidy(cu.merge_fixed_offsets(tb.read_fixed_offsets(spark, list(paths.values())), "path", strict=False))


@query("file_checksum")
def file_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _shard_folder(spark, sf_dir)
    return tb.file_checksums(spark, folder).select(_short("path"), "length", "md5")


# a tar is headers and contents in blocks of 512 bytes and two empty blocks, filled up to records of 10,240 bytes
@query("discover_media", with_ctes([MEMBERS, """
t AS (SELECT shard, sum(512 + 512 * ((size + 511) // 512)) + 1024 AS used FROM members GROUP BY 1)"""], """
SELECT shard AS path, 0 AS root_no, ((used + 10239) // 10240 * 10240)::BIGINT AS length FROM t"""))
def discover_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards stand in for media files; the second root lies inside the first."""
    folder = _shard_folder(spark, sf_dir)
    found = tb.discover_media(spark, [folder, f"{folder}/shard-00000[0-4].tar"], suffixes=["tar"])
    return found.select(_short("path"), "root_no", "length")


_CSV_ROWS = {n: (f"{e} AS {n}" if n in _INTEGER else r6(e, n)) for n, e in _ROW_FIGURES.items()}


@query("sink_trials_csv", with_ctes([ROWS], """
SELECT model_name, sample_id, 'ok' AS status, """ + ", ".join(_CSV_ROWS.values()) + """ FROM good UNION ALL
SELECT model_name, sample_id, 'error', """ + ", ".join("NULL" for _ in _CSV_ROWS) + " FROM base WHERE NOT ok"))
def sink_trials_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    path = scratch_path(spark, "trials-csv")
    tb.write_trials_csv(rows, path)
    read = spark.read.schema(rows.schema).option("header", True).csv(path)
    return tidy(read.select("model_name", "sample_id", "status", *_ROW_FIGURES))


@query("sink_summary_csv")
def sink_summary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    summary = ev.full_summary(rows, GRID, data_iter=1)
    path = scratch_path(spark, "summary-csv")
    tb.write_summary_csv(summary, path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("sink_results_jsonl", with_ctes([HISTORY], f"""
SELECT run, epoch, {r6("metric", "metric")} FROM history"""))
def sink_results_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = views.metric_history(spark, sf_dir)
    path = scratch_path(spark, "results-jsonl")
    metrics = history.groupBy("epoch").agg(F.map_from_entries(F.collect_list(F.struct("run", "metric"))).alias("metrics"))
    tb.append_results_jsonl(metrics.where("epoch % 2 = 0"), path)
    tb.append_results_jsonl(metrics.where("epoch % 2 = 1"), path)
    tb.append_results_jsonl(metrics.where("epoch % 3 = 0"), path)  # written again, as after a restart
    read = spark.read.schema("epoch bigint, metrics map<string,double>").json(path)
    return tidy(read.select("epoch", F.explode("metrics").alias("run", "metric")))


@query("sink_manifest_json", with_ctes([TOKENS, """
c AS (SELECT cluster, count(*) AS n FROM tokens WHERE cluster >= 0 GROUP BY 1)""", """
v AS (SELECT video, n, sum(n) OVER (ORDER BY video) AS e FROM (SELECT video, count(*) AS n FROM tokens GROUP BY 1))"""], """
SELECT 'totals' AS section, '' AS key, '{"stage_name":"global","num_videos":' || count(DISTINCT video) || ',"num_tokens_total":' || count(*)
  || ',"num_tokens_assigned":' || count(*) FILTER (cluster >= 0) || '}' AS body FROM tokens
UNION ALL SELECT 'argument', 'n_clusters', '{"value":"5"}' UNION ALL SELECT 'argument', 'seed', '{"value":"7"}'
UNION ALL SELECT 'unit', video || '/' || parent, '{"start_sec":' || t0 || ',"end_sec":' || t1 || '}' FROM tokens
UNION ALL SELECT 'cluster', cluster::VARCHAR, '{"count":' || n || ',"hex":"#0' || cluster || '0000"}' FROM c
UNION ALL SELECT 'video', video::VARCHAR, '{"token_start":' || (e - n)::BIGINT || ',"token_end":' || e::BIGINT || ',"token_count":' || n || '}' FROM v"""))
def sink_manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = views.tokens(spark, sf_dir)
    colors = tokens.select("cluster").distinct().withColumn("hex", F.concat(F.lit("#0"), F.col("cluster"), F.lit("0000")))
    path = scratch_path(spark, "manifest")
    units = tokens.select("video", F.col("parent").alias("layer"), F.col("t0").alias("start_sec"), F.col("t1").alias("end_sec"))
    offsets = tk.token_offsets(tokens, ["video"])
    tb.manifest_lines(tokens, offsets, colors, "global", {"n_clusters": "5", "seed": "7"}, units).write.json(path)
    return spark.read.schema("section string, key string, body string").json(path)
