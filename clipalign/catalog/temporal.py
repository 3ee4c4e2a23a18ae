"""Temporal planning queries over clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign import views
from clipalign.catalog import query, tidy
from clipalign.catalog.ctes import CLIPS, double_list, r6, uniform, with_ctes
from clipalign.catalog.sampling import GRID21
from clipalign.functions import tables
from clipalign.plans import temporal as tp

SEED = "plan"
CROP = 5.0


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.clips(spark, sf_dir)


@query("equalify_lengths", with_ctes([CLIPS, """
m AS (SELECT clip_id, a_fps, v_fps, trunc(v_fps * least(600, a_len / a_fps, v_len / v_fps))::BIGINT AS v FROM clips)"""], """
SELECT clip_id, v AS v_common, (a_fps // v_fps) * v AS a_common FROM m"""))
def equalify_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.equalify_lengths(_clips(spark, sf_dir), 600.0).select("clip_id", "v_common", "a_common")


@query("class_grid", with_ctes(["""
p AS (SELECT doc_id AS clip_id, 1 + doc_id % 3 AS m, 3 + doc_id % 19 AS n,
             CASE WHEN doc_id % 2 = 1 THEN (14 - (1 - 0.5::DOUBLE) * 13) * (16 / 25.0::DOUBLE) END AS extreme FROM documents)""", """
g AS (SELECT clip_id, i AS idx, -m + i * ((m + m) / (n - 1)) AS v FROM p, range(40) t(i) WHERE i < n
      UNION ALL SELECT clip_id, n, extreme FROM p WHERE extreme IS NOT NULL)"""], f"SELECT clip_id, idx, {r6('v', 'offset_sec')} FROM g"))
def class_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = F.col("clip_id")
    high = (clip % 3 + 1).cast("double")
    extreme = tp.trimmed_segments(F.lit(14), F.lit(0.5)) * (16 / 25.0)
    grid = tp.class_grid(-high, high, clip % 19 + 3, F.when(clip % 2 == 1, extreme))
    exploded = _clips(spark, sf_dir).select("clip_id", F.posexplode(grid).alias("idx", "offset_sec"))
    return tidy(exploded.withColumn("idx", F.col("idx").cast("bigint")))


_PLACED = """
{name}_a AS (SELECT *, 5 * v_fps AS vc, 5 * a_fps AS ac, (v_len - 5 * v_fps) / v_fps AS room FROM {source}),
{name}_b AS (SELECT *, greatest(0, -off) AS low, least(room, room - off) AS high FROM {name}_a),
{name}_c AS (SELECT *, trunc((low + (high - low) * {u}) * v_fps)::BIGINT AS vs,
       CASE WHEN room <= 0 THEN 'clip not longer than crop' WHEN low > high THEN 'no room for offset' ELSE 'ok' END AS st FROM {name}_b),
{name}_d AS (SELECT *, trunc((vs / v_fps + off) * a_fps)::BIGINT AS as0 FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN as0 < 0 AND -as0 <= a_fps / v_fps THEN 0 ELSE as0 END AS as1,
       CASE WHEN st = 'ok' AND as0 < 0 AND -as0 > a_fps / v_fps THEN 'audio starts before the clip' ELSE st END AS st1 FROM {name}_d),
{name}_f AS (SELECT *, as1 + {jitter} AS a FROM {name}_e),
{name} AS (SELECT *, CASE WHEN st1 <> 'ok' THEN st1 WHEN a + ac > a_len THEN 'audio too short'
       WHEN vs + vc > v_len THEN 'video too short' ELSE 'ok' END AS status FROM {name}_f)"""


def _jitter(seed: str, most: int) -> str:
    low, high = f"(-least(as1, {most}))", f"least(a_len - ac - as1, {most})"
    return f"({low} + floor({uniform(seed, 'clip_id')} * ({high} - {low} + 1))::BIGINT)"


def _placed(name: str, source: str, seed: str, jitter: str = "0") -> str:
    return _PLACED.format(name=name, source=source, u=uniform(f"{seed}:start", "clip_id"), jitter=jitter)


_KEEP = "clip_id, status, {r}".format(r=r6("off", "offset_sec")) + "".join(
    f", CASE WHEN status = 'ok' THEN {e} END AS {n}" for n, e in (
        ("v_start_i", "vs"), ("v_end_i", "vs + vc"), ("a_start_i", "a"), ("a_end_i", "a + ac")))
_COLS = ["clip_id", "status", "offset_sec", "v_start_i", "v_end_i", "a_start_i", "a_end_i"]
_D21 = double_list(GRID21)
_U = uniform(f"{SEED}:offset", "clip_id")
_TARGET = (f"list_position(list_transform({_D21}, lambda g: abs(g - off)), "
           f"list_min(list_transform({_D21}, lambda g: abs(g - off)))) - 1")


@query("offset_plan", with_ctes([CLIPS, f"""
gsrc AS (SELECT *, round_even({_D21}[least(20, floor({_U} * 21))::INT + 1], 2) AS off FROM clips)""", f"""
usrc AS (SELECT *, round_even(-2.0::DOUBLE + {_U} * 4.0::DOUBLE, 2) AS off FROM clips)""", f"""
bsrc AS (SELECT *, round_even(CASE WHEN oos = 1 THEN CASE WHEN x < 1.875::DOUBLE THEN x - 2 ELSE x - 1.875::DOUBLE + 0.045::DOUBLE END
                   ELSE -0.125::DOUBLE + u * (0.045::DOUBLE + 0.125::DOUBLE) END, 2) AS off
         FROM (SELECT *, {_U} AS u, {_U} * (1.875::DOUBLE + 2.0::DOUBLE - 0.045::DOUBLE) AS x, ({uniform(SEED + ":oos", "clip_id")} < 0.5)::BIGINT AS oos FROM clips))""",
    _placed("gp", "gsrc", SEED, _jitter(SEED + ":jitter", 1600)), _placed("up", "usrc", SEED), _placed("bp", "bsrc", SEED)], f"""
SELECT 'grid' AS kind, {_KEEP}, {_TARGET} AS target, NULL::BIGINT AS oos FROM gp
UNION ALL SELECT 'uniform', {_KEEP}, NULL, NULL FROM up
UNION ALL SELECT 'uniform_binary', {_KEEP}, NULL, oos FROM bp"""))
def offset_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = _clips(spark, sf_dir)
    none = F.lit(None).cast("bigint")
    grid = tp.offset_plan(clips, "clip_id", SEED, "grid", 2.0, CROP, grid=GRID21, jitter_sec=0.1)
    uniform_ = tp.offset_plan(clips, "clip_id", SEED, "uniform", 2.0, CROP)
    binary = tp.offset_plan(clips, "clip_id", SEED, "uniform_binary", 2.0, CROP)
    parts = [
        grid.select(F.lit("grid").alias("kind"), *_COLS, F.col("offset_target").alias("target"), none.alias("oos")),
        uniform_.select(F.lit("uniform").alias("kind"), *_COLS, none.alias("target"), none.alias("oos")),
        binary.select(F.lit("uniform_binary").alias("kind"), *_COLS, none.alias("target"), F.col("oos")),
    ]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("crop_bounds", with_ctes([CLIPS, """
s AS (SELECT *, round_even(((clip_id * 37) % 401 - 200) / 100, 2) AS off, (clip_id % 50) / 10 AS vsec, 5 * v_fps AS vc, 5 * a_fps AS ac FROM clips)""", """
p AS (SELECT *, trunc(vsec * v_fps)::BIGINT AS vs, trunc((vsec + off) * a_fps)::BIGINT AS as0 FROM s)""", """
q AS (SELECT *, CASE WHEN as0 < 0 AND -as0 <= a_fps / v_fps THEN 0 ELSE as0 END AS a,
        CASE WHEN as0 < 0 AND -as0 > a_fps / v_fps THEN 'audio starts before the clip' ELSE 'ok' END AS st FROM p)""", """
r AS (SELECT *, CASE WHEN st <> 'ok' THEN st WHEN a + ac > a_len THEN 'audio too short' WHEN vs + vc > v_len THEN 'video too short'
        ELSE 'ok' END AS status FROM q)"""], f"SELECT {_KEEP} FROM r"))
def crop_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = _clips(spark, sf_dir).withColumn("offset_sec", ((F.col("clip_id") * 37) % 401 - 200) / 100).withColumn(
        "v_start_i_sec", (F.col("clip_id") % 50) / 10)
    return tidy(tp.crop_bounds(clips, CROP).select(*_COLS))


@query("audio_jitter", with_ctes([CLIPS, f"""
j AS (SELECT clip_id, CASE WHEN a_len > 320 THEN (clip_id * 97) % (a_len - 320) END AS a0, a_len - 320 AS last_a FROM clips)"""], f"""
SELECT clip_id, CASE WHEN a0 IS NULL THEN 'no room' ELSE 'ok' END AS status, a0 AS a_start_i,
  -least(a0, 8000) + floor({uniform("jit", "clip_id")} * (least(last_a - a0, 8000) + least(a0, 8000) + 1))::BIGINT AS a_jitter_i FROM j"""))
def audio_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.col("a_len") - 320
    clips = _clips(spark, sf_dir).withColumn("a_start_i", F.when(last > 0, F.try_mod(F.col("clip_id") * 97, last)))
    status = F.when(F.col("a_start_i").isNull(), "no room").otherwise("ok")
    jitter = tp.jitter_frames(F.col("a_start_i"), last, tp.to_frames(F.lit(0.5), F.col("a_fps")), "jit", F.col("clip_id"))
    return clips.select("clip_id", status.alias("status"), "a_start_i", F.when(status == "ok", jitter).alias("a_jitter_i"))


@query("center_or_random_crop", with_ctes([CLIPS], f"""
SELECT clip_id, CASE WHEN v_len = 125 THEN 0 WHEN v_len < 125 THEN NULL
  WHEN clip_id % 2 = 0 THEN floor({uniform("crop", "clip_id")} * (v_len - 125 + 1))::BIGINT
  ELSE round_even((v_len - 125) / 2, 0)::BIGINT END AS left_i FROM clips"""))
def center_or_random_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = tp.crop_start(F.col("v_len"), F.lit(125), F.col("clip_id") % 2 == 0, "crop", F.col("clip_id"))
    return _clips(spark, sf_dir).select("clip_id", start.alias("left_i"))


@query("syncability_plan", with_ctes([CLIPS, f"""
ssrc AS (SELECT *, round_even(CASE WHEN sync = 1 THEN {_D21}[least(20, floor(u * 21))::INT + 1] WHEN u < 0.5 THEN -4.8::DOUBLE ELSE 4.8::DOUBLE END, 2) AS off
  FROM (SELECT *, {_U} AS u, ({uniform(SEED + ":sync", "clip_id")} < 0.5)::BIGINT AS sync FROM clips))""",
    _placed("sp", "ssrc", SEED).replace("5 * v_fps", "trunc(4.8::DOUBLE * v_fps)::BIGINT").replace("5 * a_fps", "trunc(4.8::DOUBLE * a_fps)::BIGINT")], f"""
SELECT {_KEEP}, sync AS sync_target, {_TARGET} AS offset_target FROM sp"""))
def syncability_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = tp.syncability_plan(_clips(spark, sf_dir), "clip_id", SEED, GRID21, 16, 14, 0.5, 25.0)
    return tidy(plan.select(*_COLS, "sync_target", "offset_target"))


def _ranges_sql(n: str, random: bool, jitter: int) -> list[str]:
    start = f"floor({uniform('r:seg', 'clip_id')} * (v_len - span_v + 1))::BIGINT" if random else "floor((v_len - span_v) / 2)::BIGINT"
    most = f"least({jitter}, a0, a_len - a0 - span_a)"
    shift = f"(-{most} + floor({uniform('r:segjit', 'clip_id')} * (2 * {most} + 1))::BIGINT)" if jitter else "0"
    return [CLIPS, f"""
r1 AS (SELECT *, floor((v_len - 16) / 8)::BIGINT + 1 AS mv, floor((a_len - 10240) / 5120)::BIGINT + 1 AS ma FROM clips)""", f"""
r2 AS (SELECT *, least(mv, ma) AS most, {n} AS n FROM r1)""", """
r3 AS (SELECT *, trunc((n * 0.5::DOUBLE + 0.5) * 16)::BIGINT AS span_v, trunc((n * 0.5::DOUBLE + 0.5) * 10240)::BIGINT AS span_a FROM r2)""", f"""
r4 AS (SELECT *, {start} AS v0 FROM r3)""", """
r5 AS (SELECT *, trunc(v0 / v_fps * a_fps)::BIGINT AS a0 FROM r4)""", f"""
r6 AS (SELECT *, a0 + {shift} AS a1 FROM r5)""", """
r7 AS (SELECT *, CASE WHEN n < 1 OR n > most THEN 'too few frames for the segments'
   WHEN a1 < 0 OR a1 + (n - 1) * 5120 + 10240 > a_len THEN 'audio range out of bounds'
   WHEN v0 + (n - 1) * 8 + 16 > v_len THEN 'video range out of bounds' ELSE 'ok' END AS status FROM r6)"""]


_RANGE_BODY = """
SELECT clip_id, status, i AS seg, v0 + i * 8 AS v_start, v0 + i * 8 + 16 AS v_end, a1 + i * 5120 AS a_start, a1 + i * 5120 + 10240 AS a_end
FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM r7 WHERE status = 'ok')
UNION ALL SELECT clip_id, status, NULL, NULL, NULL, NULL, NULL FROM r7 WHERE status <> 'ok'"""


@query("segment_ranges", with_ctes(_ranges_sql("14::BIGINT", True, 3200), _RANGE_BODY))
def segment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.segment_ranges(_clips(spark, sf_dir), 16, 0.5, 14, random_start=True, jitter_sec=0.2, seed="r")


@query("segment_ranges_full", with_ctes(_ranges_sql("least(mv, ma)", False, 0), _RANGE_BODY))
def segment_ranges_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.segment_ranges(_clips(spark, sf_dir), 16, 0.5)


@query("segment_window", with_ctes([CLIPS, """
w AS (SELECT clip_id, v_len, 16 + (5 + clip_id % 10 - 1) * 8 AS req FROM clips)"""], f"""
SELECT clip_id, req AS required_frames, {r6("ceil((req + 1) / 25 * 1000) / 1000", "safe_seconds")}, v_len >= req AS fits,
  4.68::DOUBLE + 1e-9 >= ceil((req + 1) / 25 * 1000) / 1000 AS chunk_is_safe FROM w"""))
def segment_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = tp.segment_window(F.lit(16), F.col("clip_id") % 10 + 5, F.lit(0.5), 25)
    clips = _clips(spark, sf_dir).select("clip_id", "v_len", *[c.alias(n) for n, c in window.items()])
    fits = F.col("v_len") >= F.col("required_frames")
    safe = tp.chunk_is_safe(F.lit(4.68), F.col("safe_seconds"))
    return tidy(clips.withColumn("fits", fits).withColumn("chunk_is_safe", safe).drop("v_len"))


@query("chunk_starts", with_ctes(["""
d AS (SELECT doc_id AS clip_id, n_chars / 25 AS dur FROM documents)""", """
s AS (SELECT clip_id, dur, unnest(list_transform(generate_series(0, ceil((dur - 9.0::DOUBLE + 1e-6) / 3.5::DOUBLE)::BIGINT - 1), lambda i: i * 3.5::DOUBLE)) AS s
      FROM d WHERE dur > 9)""", """
t AS (SELECT clip_id, s FROM s UNION ALL SELECT clip_id, any_value(dur) - 9.0::DOUBLE FROM s GROUP BY 1
      HAVING abs(max(s) - (any_value(dur) - 9.0::DOUBLE)) > 1e-3)"""], f"""
SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY start_sec) - 1 AS chunk, start_sec FROM (
  SELECT DISTINCT clip_id, {r6("s", "start_sec", 3)} FROM t UNION ALL SELECT clip_id, 0.0::DOUBLE FROM d WHERE dur <= 9)"""))
def chunk_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = tp.chunk_starts(F.col("v_len") / F.col("v_fps"), F.lit(9.0), F.lit(3.5))
    exploded = _clips(spark, sf_dir).select("clip_id", F.posexplode(starts).alias("chunk", "start_sec"))
    return tidy(exploded.withColumn("chunk", F.col("chunk").cast("bigint")))


@query("window_starts", with_ctes([CLIPS, """
c AS (SELECT clip_id, v_len / v_fps AS dur, a_len FROM clips)"""], f"""
SELECT clip_id, 'seconds' AS unit, {r6("unnest(list_transform(generate_series(0, greatest(1, floor((dur - 2.0::DOUBLE + 1e-6) / 0.75::DOUBLE)::BIGINT + 1) - 1), lambda i: i * 0.75::DOUBLE))", "start")}
FROM c
UNION ALL
SELECT clip_id, 'samples', unnest(list_transform(generate_series(0, (CASE WHEN n > 1 AND (n - 2) * 40000 + 80000 >= a_len THEN n - 1 ELSE n END) - 1), lambda i: i * 40000.0::DOUBLE))
FROM (SELECT *, ceil(greatest(a_len, 1) / 40000)::BIGINT AS n FROM c)"""))
def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = _clips(spark, sf_dir)
    seconds = tp.window_starts(F.col("v_len") / F.col("v_fps"), F.lit(2.0), F.lit(0.75))
    samples = tp.sample_chunk_starts(F.col("a_len"), F.lit(80000), F.lit(40000)).cast("array<double>")
    both = F.array(F.struct(F.lit("seconds").alias("unit"), seconds.alias("starts")), F.struct(F.lit("samples").alias("unit"), samples.alias("starts")))
    return tidy(clips.select("clip_id", F.inline(both)).select("clip_id", "unit", F.explode("starts").alias("start")))


@query("resample_index", """
SELECT clip_id, i AS frame, trunc(i * (25 / 2.0::DOUBLE))::BIGINT AS source_frame FROM (
  SELECT doc_id AS clip_id, unnest(generate_series(0, ceil((n_chars - 1e-9::DOUBLE) / (25 / 2.0::DOUBLE))::BIGINT - 1)) AS i FROM documents)""")
def resample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    indices = tp.resample_indices(F.col("v_len"), F.col("v_fps"), F.lit(2.0))
    exploded = _clips(spark, sf_dir).select("clip_id", F.posexplode(indices).alias("frame", "source_frame"))
    return exploded.withColumn("frame", F.col("frame").cast("bigint"))


@query("token_to_frame", """
SELECT event_id, greatest(0, least(frames - 1, round_even((t + 0.5::DOUBLE) * frames / n - 0.5, 0)::BIGINT)) AS frame
FROM (SELECT event_id, event_id % 8 AS t, 8 AS n, 1 + event_id % 40 AS frames FROM events)""")
def token_to_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = tp.token_frame(F.col("event_id") % 8, F.lit(8), F.col("event_id") % 40 + 1)
    return views.table(spark, sf_dir, "events").select("event_id", frame.alias("frame"))


@query("token_centers", with_ctes(["""
c AS (SELECT doc_id AS clip_id, n_chars * 640 - (doc_id % 7) * 160 AS n FROM documents)""", """
s AS (SELECT clip_id, n, unnest(list_transform(generate_series(0, (CASE WHEN k > 1 AND (k - 2) * 160000 + 160000 >= n THEN k - 1 ELSE k END) - 1), lambda i: i * 160000)) AS start
      FROM (SELECT *, ceil(greatest(n, 1) / 160000)::BIGINT AS k FROM c))"""], f"""
SELECT clip_id, start, i::INTEGER AS token,
  {r6("start / 16000.0::DOUBLE + (i + 0.5::DOUBLE) / (5 / greatest((least(n, start + 160000) - start) / 16000.0::DOUBLE, 1e-9))", "center")}
FROM s, range(5) t(i)"""))
def token_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(tp.token_centers(_clips(spark, sf_dir), "clip_id", "a_len", 16000, 10.0, 10.0, 5))


@query("patch_grid", """
SELECT clip_id, s AS window_start, f * 16 AS f0, least(f * 16 + 16, 56) AS f1, s + t * 64 AS t0, least(s + t * 64 + 16, n) AS t1
FROM (SELECT doc_id AS clip_id, n_chars AS n, unnest(list_transform(generate_series(0, ceil(greatest(n_chars, 1) / 512)::BIGINT - 1), lambda i: i * 512)) AS s FROM documents),
  range(3) a(f), range(8) b(t) WHERE s + t * 64 < n""")
def patch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.patch_grid(_clips(spark, sf_dir), "clip_id", "v_len", 56, 16, 16, 64, 512)


@query("grid_points_function", with_ctes([CLIPS], f"""
SELECT clip_id, i::INTEGER AS idx, {r6("-(1 + clip_id % 3) + i * ((1 + clip_id % 3) * 2.0::DOUBLE / 20)", "value")} FROM clips, range(21) t(i)"""))
def grid_points_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    return tidy(spark.sql(
        "SELECT clip_id, g.idx, g.value FROM {clips} c, LATERAL grid_points(-(1.0D + clip_id % 3), 1.0D + clip_id % 3, 21) g",
        clips=_clips(spark, sf_dir)))


@query("segment_plan_function", with_ctes([CLIPS], """
SELECT clip_id, i AS seg, (v_len - 120) // 2 + i * 8 AS v_start, (v_len - 120) // 2 + i * 8 + 16 AS v_end FROM clips, range(14) t(i) WHERE v_len >= 120"""))
def segment_plan_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    return spark.sql(
        "SELECT clip_id, s.seg, s.v_start, s.v_end FROM {clips} c, LATERAL segment_plan(v_len, 16L, 8L, 14L) s",
        clips=_clips(spark, sf_dir))
