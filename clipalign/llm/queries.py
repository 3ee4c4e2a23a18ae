"""One query per operator over the whole tables, with SQL where SQL can state it in reasonable time."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign.session import scratch_path

from . import alignment, bytepair, decontaminate, language, licenses, lines, mixing, quality, sharding, simhash, tokencount, tokenfiles, whitening

#: Bytes of text of a shard, at most.
SHARD_BYTES = 1 << 20
#: Target weights of the mix; all other sources share the rest.
MIX_WEIGHTS = {"src0": 5, "src1": 3, "src2": 2}
MIX_REST = 10
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
#: Whitened dimensions.
COMPONENTS = 8


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *(columns or ("text",)))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_documents(spark, sf_dir))
    base = F.filter("license.places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    return found.select("doc_id", "license.n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), F.array_join("license.base_labels", ",").alias("base_labels"),
                        F.array_join("license.labels", ",").alias("labels"), "license.score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_documents(spark, sf_dir))
    return kept.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokenfiles.write_tokens(_documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER))
    return tokenfiles.with_crc(tokenfiles.read_tokens(spark, path))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_join(F.array_sort("contamination.item_ids"), ",")
    return found.select("doc_id", "contamination.n_words", decontaminate.n_hit().alias("n_hit"),
                        F.size("contamination.item_ids").cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
                        decontaminate.is_contaminated().alias("contaminated"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_documents(spark, sf_dir), SHARD_BYTES)
    return placed.select("doc_id", "shard.shard", "shard.depth", "shard.shard_bytes", "shard.shard_docs")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "text", "lang")
    out = language.held_out(F.col("doc_id"))
    found = language.predict(docs.select("doc_id", "text"), language.learn(docs, ~F.coalesce(out, F.lit(False))))
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score",
                        "language.margin", "language.accepted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_documents(spark, sf_dir))
    return found.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                                                             "n_failed_lines", "kept")])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.mix(_documents(spark, sf_dir, "source"), MIX_WEIGHTS, MIX_REST)
    return placed.select("doc_id", *[f"mix.{c}" for c in ("source_group", "block", "slot", "release", "deadline", "position")])


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokencount.read_vocabulary(public_tokenizers.path(TOKENIZER))
    return tokencount.count_tokens(_documents(spark, sf_dir), vocabulary).select("doc_id", "tokens.n_words", "tokens.n_tokens")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES), packed=True)
    path = scratch_path(spark, "aligned")
    # the keys are fixed by being written, once for each row
    alignment.write_aligned(aligned.select(F.monotonically_increasing_id().alias("key"), "doc_id", "alignment"), path)
    aligned = spark.read.parquet(path)
    scores = alignment.score_links(aligned, alignment.pair_counts(aligned), "key")
    texts = aligned.select("key", "doc_id", "alignment.n_a", "alignment.n_b", "alignment.n_groups", "alignment.groups_sha256")
    return texts.join(scores, "key").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    whitened = whitening.whiten(vectors, "embedding", COMPONENTS).select("vec_id", "whitening.*")
    rows = whitened.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "value"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"),
                       F.col("explained")[F.col("place")].alias("explained"), "identity_error")


def op13_bytepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    encoded = bytepair.encode_texts(_documents(spark, sf_dir), ranks).select("doc_id", "encoded")
    decoded = bytepair.decode_ids(encoded, F.col("encoded.ids"), ranks)
    ids = F.array_join(F.col("encoded.ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("encoded.ids").cast("bigint").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2("decoded.raw", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_line_dedup, op3_token_output, op4_decontamination, op5_simhash, op6_sharding,
                                   op7_language_id, op8_quality_rules, op9_mixing, op10_token_counts, op11_alignment, op12_whitening, op13_bytepair)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _sql_licenses() -> str:
    """Each template by its words and key phrases, looked for at every place of every text."""
    known = licenses.templates()
    values = ", ".join(
        "({}, '{}', {}, [{}], [{}])".format(
            t, x.label, str(x.base).lower(), ", ".join(f"'{w.decode()}'" for w in x.words),
            ", ".join(f"{{'a': {a}, 'w': [{', '.join(repr(w.decode()) for w in x.words[a:b])}]}}" for a, b in x.keys))
        for t, x in enumerate(known))
    return f"""
WITH t(id, label, base, words, keys) AS (VALUES {values}),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
spots AS (SELECT doc_id, id, p - keys[1].a AS at FROM word JOIN t ON word.word = t.keys[1].w[1]),
hits AS (
  SELECT d.doc_id, t.label, t.base, s.at,
         len(list_filter(range(1, len(t.words) + 1), lambda i: coalesce(s.at + i >= 1 AND w[s.at + i] = t.words[i], false))) / len(t.words) AS share
  FROM spots s JOIN d ON s.doc_id = d.doc_id JOIN t ON s.id = t.id
  WHERE len(list_filter(t.keys, lambda k: s.at + k.a >= 0 AND w[s.at + k.a + 1 : s.at + k.a + len(k.w)] = k.w)) = len(t.keys))
SELECT d.doc_id, len(w)::BIGINT AS n_words, count(h.at) FILTER (h.base)::BIGINT AS n_base, min(h.at) FILTER (h.base) AS first_word,
       max(h.at) FILTER (h.base) AS last_word, coalesce(string_agg(DISTINCT h.label, ',' ORDER BY h.label) FILTER (h.base), '') AS base_labels,
       coalesce(string_agg(DISTINCT h.label, ',' ORDER BY h.label), '') AS labels, coalesce(max(h.share), 0)::DOUBLE AS score
FROM d LEFT JOIN hits h ON d.doc_id = h.doc_id GROUP BY d.doc_id, w"""


_SQL_LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(k.doc_id < c.keeper, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

_SQL_CONTAMINATION = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT item_id, size, w[s + 1 : s + size] AS words FROM (
          SELECT item_id, w, least(13, len(w)) AS size, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
spots AS (SELECT doc_id, size, s, w[s + 1 : s + size] AS words FROM (
         SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS s FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT spots.doc_id, spots.s, spots.size, win.item_id FROM spots JOIN win ON spots.size = win.size AND spots.words = win.words),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id"""

_BITS = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT"

_SQL_SHARDS = f"""
WITH d AS (SELECT doc_id, {_BITS} AS bits, coalesce(strlen(text), 0) AS size FROM documents),
p AS (SELECT *, unnest(range(0, 61)) AS depth FROM d),
b AS (SELECT depth, bits >> (60 - depth) AS prefix, sum(size)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY ALL
      HAVING sum(size) <= {SHARD_BYTES} OR depth = 60),
f AS (SELECT p.doc_id, p.bits, min(b.depth) AS depth, arg_min(b.shard_bytes, b.depth) AS shard_bytes, arg_min(b.shard_docs, b.depth) AS shard_docs
      FROM p JOIN b ON p.depth = b.depth AND p.bits >> (60 - p.depth) = b.prefix GROUP BY p.doc_id, p.bits)
SELECT doc_id, left(lpad(bin(bits), 60, '0'), depth::INTEGER) AS shard, depth, shard_bytes, shard_docs FROM f"""

_LINE_ENDS = quality.ENDING.replace("'", "''")

_SQL_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{quality.SPACE}'), lambda x: x <> '') AS w
           FROM documents),
x AS (SELECT doc_id, w, t, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 4], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) > 5)),
twice AS (SELECT doc_id, words FROM win GROUP BY doc_id, words HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (
          SELECT win.doc_id, unnest(range(s, s + 5)) AS p FROM win JOIN twice ON win.doc_id = twice.doc_id AND win.words = twice.words) GROUP BY doc_id),
l AS (SELECT doc_id, line, list_filter(regexp_split_to_array(line, '{quality.SPACE}'), lambda y: y <> '') AS lw FROM (SELECT doc_id, unnest(lines) AS line FROM x)),
j AS (SELECT doc_id, line,
        length(line) - length(replace(line, '|', '')) >= 3
        OR len(regexp_extract_all(line, '{quality.SYMBOLS}')) * 10 > length(line)
        OR (len(regexp_extract_all(line, '\p{{Lu}}')) * 2 > length(line) AND len(lw) >= 5)
        OR (len(lw) >= 20 AND len(list_distinct(lw)) * 10 < len(lw) * 3)
        OR (len(lw) < {quality.SHORT_LINE} AND NOT regexp_matches(line, '{_LINE_ENDS}'))
        OR (len(lw) < {quality.BOILERPLATE_LINE} AND regexp_matches(line, '{quality.BOILERPLATE}')) AS failed FROM l),
v AS (SELECT doc_id, count(*) FILTER (failed) AS n_failed, sum(length(line)) AS everything, coalesce(sum(length(line)) FILTER (NOT failed), 0) AS remaining
      FROM j GROUP BY doc_id),
m AS (SELECT x.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '{quality.SYMBOLS}'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_failed, 0)::BIGINT AS n_failed_lines,
        coalesce(remaining >= {quality.MIN_KEPT} * everything, false) AS enough
      FROM x LEFT JOIN rep ON x.doc_id = rep.doc_id LEFT JOIN v ON x.doc_id = v.doc_id)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_failed_lines,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND enough AS kept FROM m"""


def _sql_mixing() -> str:
    """The schedule slot by slot, then each document's block in it."""
    shares = mixing.reduced({**MIX_WEIGHTS, mixing.REST: MIX_REST})
    period = sum(shares.values())
    weights = "[" + ", ".join(map(str, shares.values())) + "]"
    names = "[" + ", ".join(f"'{s}'" for s in shares) + "]"
    listed = ", ".join(f"'{s}'" for s in MIX_WEIGHTS)
    n = len(shares)
    return f"""
WITH RECURSIVE run(t, done, pick) AS (
  SELECT -1, list_transform(range(0, {n}), lambda i: 0), 0
  UNION ALL
  SELECT t + 1, list_transform(range(1, {n + 1}), lambda i: done[i] + CASE WHEN i = chosen THEN 1 ELSE 0 END), chosen
  FROM (SELECT t, done, list_min(list_transform(
          list_filter(range(1, {n + 1}), lambda i: done[i] < {weights}[i] AND done[i] * {period} // {weights}[i] <= t + 1),
          lambda i: {{'deadline': ((done[i] + 1) * {period} + {weights}[i] - 1) // {weights}[i], 'i': i}})).i AS chosen FROM run WHERE t < {period - 1})),
placed AS (SELECT {names}[pick] AS g, {weights}[pick] AS w, done[pick] - 1 AS k, t FROM run WHERE t >= 0),
d AS (SELECT doc_id, CASE WHEN source IN ({listed}) THEN source ELSE '{mixing.REST}' END AS g, {_BITS} AS bits FROM documents),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY bits, doc_id) - 1 AS rank FROM d),
b AS (SELECT *, rank // {mixing.BLOCK} AS block FROM r)
SELECT doc_id, b.g AS source_group, block, block // w * {period} + t AS slot, block * {period} // w AS release,
       ((block + 1) * {period} + w - 1) // w AS deadline, (block // w * {period} + t) * {mixing.BLOCK} + rank % {mixing.BLOCK} AS position
FROM b JOIN placed ON b.g = placed.g AND b.block % w = placed.k"""


ORACLES = {
    "op1_license_scan": _sql_licenses(),
    "op2_line_dedup": _SQL_LINES,
    "op4_decontamination": _SQL_CONTAMINATION,
    "op6_sharding": _SQL_SHARDS,
    "op8_quality_rules": _SQL_QUALITY,
    "op9_mixing": _sql_mixing(),
}
