"""String queries: slugs, stems, captions and training-log parsing."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign import views
from clipalign.catalog import query, tidy
from clipalign.catalog.ctes import LOG_LINES, r6, with_ctes
from clipalign.functions import audio, scalars, vectors
from clipalign.operators import text
from clipalign.session import scratch_path
from clipalign.sources import tables


@query("slug_prefix", r"""
SELECT page_id, trim(regexp_replace(lower(trim(url)), '[^a-z0-9_]+', '_', 'g'), '_') AS slug FROM pages""")
def slug_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", scalars.slug(F.col("url")).alias("slug"))


@query("safe_stem", r"""
SELECT page_id,
  coalesce(nullif(regexp_replace(s, '[^\p{L}\p{N}\-_.]', '_', 'g'), ''), 'video') AS stem,
  coalesce(nullif(regexp_replace(s, '[^\p{L}\p{N}\-_.]', '_', 'g'), ''), 'video') || '_' || printf('%04d', page_id) AS indexed_stem,
  substr(coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._=\-]+', '__', 'g'), '._-'), ''), 'input'), 1, 24) AS short_slug
FROM (SELECT *, CASE WHEN f LIKE '_%.%' THEN regexp_replace(f, '(.)\.[^.]*$', '\1') ELSE f END AS s
      FROM (SELECT page_id, url, regexp_extract(url, '([^/]*)/*$', 1) AS f FROM pages))""")
def safe_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = scalars.safe_stem(F.col("url"))
    index = scalars.padded(F.col("page_id"), 4)
    return views.table(spark, sf_dir, "pages").select(
        "page_id", stem.alias("stem"), F.concat(stem, F.lit("_"), index).alias("indexed_stem"),
        scalars.bounded_slug(F.col("url"), 24).alias("short_slug"))


@query("offset_key", """
SELECT event_id, format('{:.6g}', (value - 100) / 7) AS offset_key, format('{:.6g}', value) AS value_key FROM events""")
def offset_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select(
        "event_id", scalars.six_digit_key((F.col("value") - 100) / 7).alias("offset_key"),
        scalars.six_digit_key(F.col("value")).alias("value_key"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# every named entity of the HTML standard, from the table in Python's library
_ENTITIES = ", ".join(f"{_text(name)}: {_text(char)}" for name, char in html5.items() if name.endswith(";"))


def _unescape(sql: str) -> str:
    name = "regexp_extract(p, '^[A-Za-z0-9]+;')"
    return f"""array_to_string(list_transform(string_split({sql}, '&'), lambda p, i: CASE WHEN i = 1 THEN p
      WHEN regexp_matches(p, '^#[0-9]{{1,6}};') THEN chr(regexp_extract(p, '^#([0-9]+);', 1)::INTEGER) || regexp_replace(p, '^#[0-9]+;', '')
      WHEN named.m[{name}] IS NOT NULL THEN named.m[{name}] || p[len({name}) + 1:] ELSE '&' || p END), '')"""


# the white space characters one by one, where a pattern has no flag for them
_SPACE = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CAPTIONS = f"""
named AS (SELECT MAP {{{_ENTITIES}}} AS m),
undone AS (SELECT id, CASE WHEN contains(txt, '&') THEN {_unescape("once")} ELSE txt END AS txt
  FROM (SELECT id, txt, CASE WHEN contains(txt, '&') THEN {_unescape("txt")} ELSE txt END AS once
        FROM (SELECT page_id AS id, html AS txt FROM pages UNION ALL SELECT doc_id + 1000000000, text FROM documents), named), named),
captions AS (
  SELECT id, lower(trim(regexp_replace(txt, '[{_SPACE}]+', ' ', 'g'))) AS caption FROM undone
)"""


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("txt"))
    docs = views.table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000000000).alias("id"), F.col("text").alias("txt"))
    return pages.unionByName(docs)


@query("caption_clean", with_ctes([CAPTIONS], "SELECT id, length(caption) AS n, md5(caption) AS digest FROM captions"))
def caption_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _captions(spark, sf_dir).select("id", scalars.clean_caption(F.col("txt")).alias("c"))
    return cleaned.select("id", F.length("c").alias("n"), F.md5("c").alias("digest"))


@query("caption_pretokens", with_ctes([CAPTIONS, rf"""
w AS (SELECT id, regexp_extract_all(caption, '{text.scalars.CAPTION_WORD.replace("'", "''")}') AS words FROM captions)"""], """
SELECT id, len(words) AS n_words, least(len(words) + 2, 77) AS used_length, len(words) + 2 > 77 AS truncated,
  words[1] AS first_word, words[least(len(words), 75)] AS last_kept_word FROM w"""))
def caption_pretokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.caption_statistics(_captions(spark, sf_dir), "txt")


_NUM = text.NUMBER


def _metric_sql(metric: str, group: int) -> str:
    pattern = rf"\b{metric}\s*:\s*({_NUM})(?:\s*\(({_NUM})\))?"
    return f"nullif(regexp_extract(value, '{pattern}', {group}), '')::DOUBLE"


_METRICS = [m.lower() for m in text.PROGRESS_METRICS]
_AVERAGED = [m.lower() for m in text.AVERAGED_METRICS]
#: Lines of a pair of logs. Those of odd number have no running averages.
LOG_LENGTH = 4096
_LOG = f"{{0}} // {LOG_LENGTH} * 2 + {{0}} % 2"
PROGRESS = f"""{LOG_LINES},
hits AS (
  SELECT {_LOG.format('line_no')} AS log, regexp_extract(value, '{text.PROGRESS_LINE}', 1) AS p, regexp_extract(value, '{text.PROGRESS_LINE}', 2)::BIGINT AS epoch,
    regexp_extract(value, '{text.PROGRESS_LINE}', 3)::BIGINT AS seen_in_phase,
    regexp_extract(value, '{text.PROGRESS_LINE}', 4)::BIGINT AS phase_total,
    {", ".join(f"{_metric_sql(m, 1)} AS {m.lower()}, {_metric_sql(m, 2)} AS {m.lower()}_avg" for m in text.PROGRESS_METRICS)}
  FROM lines WHERE regexp_matches(value, '{text.PROGRESS_LINE}')
),
progress AS (
  SELECT DISTINCT log, CASE WHEN p IN ('Valid', 'Val') THEN 'Eval' ELSE p END AS phase, epoch, seen_in_phase, phase_total,
    epoch * phase_total + seen_in_phase AS phase_progress,
    {", ".join(f"{m}, {m}_avg" for m in _METRICS)}
  FROM hits WHERE coalesce({", ".join(_METRICS)}) IS NOT NULL
)"""


@query("log_progress_parse", with_ctes([PROGRESS], f"""
SELECT log, phase, epoch, seen_in_phase, phase_total, phase_progress,
  {", ".join(f"{r6(m, m)}, {r6(f'{m}_avg', f'{m}_avg')}" for m in _METRICS)},
  {", ".join(r6(f"CASE WHEN count({m}_avg) OVER (PARTITION BY log) > 0 THEN {m}_avg ELSE {m} END", f"{m}_plot")
             for m in _AVERAGED)} FROM progress"""))
def log_progress_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_log(text.parse_progress(_logs(views.log_lines(spark, sf_dir))))


def _logs(lines: DataFrame) -> DataFrame:
    """The lines written to log files in their order, as many as they fill, and read again. Every second log has no running averages."""
    path = scratch_path(lines.sparkSession, "logs")
    logs = lines.withColumn("log", F.floor(F.col("line_no") / LOG_LENGTH) * 2 + F.col("line_no") % 2).repartition("log").sortWithinPartitions("log", "line_no")
    logs.select("log", "value").write.partitionBy("log").text(path)
    return tables.read_log(lines.sparkSession, path)


def _by_log(parsed: DataFrame) -> DataFrame:
    log = F.regexp_extract("file", r"/log=(\d+)/", 1).cast("bigint").alias("log")
    return tidy(parsed.select(log, *[F.col(c) for c in parsed.columns if c != "file"]))


def _epoch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    head = F.concat(F.when(F.col("event_id") % 5 == 0, "valid").otherwise("train"), F.lit(" ("),
                    (F.dayofyear("ts") - 1).cast("string"), F.lit(")"))
    score = F.concat(F.lit("0."), (F.col("event_id") % 10).cast("string"))
    line = F.when(F.col("event_id") % 3 == 0, F.concat(
        head, F.lit(": total_loss "), F.format_string("%.2f", F.col("value")), F.lit("; done"))).otherwise(F.concat(
            head, F.lit(" metrics: {'accuracy_1': "), score, F.lit(", 'accuracy_5': 0.9, 'accuracy_1_tol1': "), score, F.lit("}")))
    return e.select(F.col("event_id").alias("line_no"), line.alias("value"))


EPOCH_LINES = f"""
elines AS (
  SELECT {_LOG.format('event_id')} AS log, row_number() OVER (PARTITION BY {_LOG.format('event_id')} ORDER BY event_id) AS line_no, CASE WHEN event_id % 5 = 0 THEN 'valid' ELSE 'train' END AS phase,
    (dayofyear(ts) - 1)::BIGINT AS epoch, CASE WHEN event_id % 3 = 0 THEN row_number() OVER (PARTITION BY {_LOG.format('event_id')} ORDER BY event_id) END AS loss_line,
    CASE WHEN event_id % 3 = 0 THEN value END AS loss, CASE WHEN event_id % 3 <> 0 THEN (event_id % 10) / 10.0 END AS acc
  FROM events
),
owned AS (SELECT *, last_value(loss_line IGNORE NULLS) OVER (PARTITION BY log, phase, epoch ORDER BY line_no) AS owner FROM elines)"""


@query("log_epoch_parse", with_ctes([EPOCH_LINES], f"""
SELECT log, phase, epoch, owner AS line_no, {r6("max(loss)", "loss")},
  {r6("arg_max(acc, line_no) FILTER (acc IS NOT NULL)", "accuracy_1")},
  CASE WHEN count(acc) > 0 THEN 0.9::DOUBLE END AS accuracy_5,
  {r6("arg_max(acc, line_no) FILTER (acc IS NOT NULL)", "accuracy_1_tol1")}
FROM owned WHERE owner IS NOT NULL GROUP BY 1, 2, 3, 4"""))
def log_epoch_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_log(text.parse_epochs(_logs(_epoch_lines(spark, sf_dir))))


@query("audio_array_ops", with_ctes(["""
w AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS l, embedding[33:64]::DOUBLE[] AS r, embedding::DOUBLE[] AS v FROM embeddings)""", """
o AS (SELECT vec_id, list_transform(generate_series(1, 32), lambda i: (l[i] + r[i]) / 2) AS mono,
        list_transform(v, lambda x: ln(x + 1.5)) AS logged, list_transform(v, lambda x: (x + 4.2677393) / (2 * 4.5689974)) AS std,
        list_transform(v, lambda x: greatest(-1, least(1, x * 6))) AS loud,
        list_concat(v, list_transform(generate_series(1, 16), lambda i: 0.5::DOUBLE)) AS padded, v[1:40] AS cut FROM w)"""],
    "SELECT vec_id, " + ", ".join(r6(f"list_sum({c})", c) for c in ("mono", "logged", "std", "loud", "padded", "cut"))
    + ", len(padded) AS n_padded, len(cut) AS n_cut FROM o"))
def audio_array_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", vectors.as_double(F.col("embedding")).alias("v"))
    v = F.col("v")
    shaped = e.select(
        "vec_id", audio.mono(F.slice(v, 1, 32), F.slice(v, 33, 32)).alias("mono"), audio.log_offset(v, 1.5).alias("logged"),
        audio.standardize(v, -4.2677393, 4.5689974).alias("std"), audio.gain(v, 6.0).alias("loud"),
        audio.pad_or_truncate(v, 80, 0.5).alias("padded"), audio.pad_or_truncate(v, 40).alias("cut"))
    sums = [vectors.total(F.col(c)).alias(c) for c in ("mono", "logged", "std", "loud", "padded", "cut")]
    return tidy(shaped.select("vec_id", *sums, F.size("padded").alias("n_padded"), F.size("cut").alias("n_cut")))


@query("audio_noise")
def audio_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise is random by nature; a test checks its spread and that a second run repeats it."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", vectors.as_double(F.col("embedding")).alias("v"))
    noisy = audio.add_noise(F.col("v"), 0.01, "noise", F.col("vec_id"))
    return tidy(e.select("vec_id", vectors.total(noisy).alias("total")))
