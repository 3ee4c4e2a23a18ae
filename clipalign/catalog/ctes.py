"""SQL building blocks: the domain tables as common table expressions."""

from __future__ import annotations

from collections.abc import Sequence


def with_ctes(ctes: Sequence[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def r6(expr: str, alias: str | None = None, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)" + (f" AS {alias}" if alias else "")


def double_list(values: Sequence[float]) -> str:
    return "([" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[])"


def uniform(seed: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def digest(seed: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"md5({text})"


UNIT = """
unit AS (
  SELECT vec_id, label::BIGINT AS target,
         list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS u
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
)"""

CLASS_VECTORS = """
class_mean AS (
  SELECT cls, list(m ORDER BY pos) AS w FROM (
    SELECT cls, pos, avg(x) AS m
    FROM (SELECT target AS cls, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM unit) GROUP BY cls, pos
  ) GROUP BY cls
),
class_vec AS (
  SELECT cls, list_transform(w, lambda x: x / greatest(sqrt(list_inner_product(w, w)), 1e-12)) AS w FROM class_mean
)"""

TRIALS = f"""{UNIT},{CLASS_VECTORS},
trials AS (
  SELECT vec_id AS trial, CASE WHEN vec_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS model_name,
         '/shards/shard-' || (vec_id % 8) || '.tar::clip' || vec_id || '.mp4' AS sample_id, target,
         list(100.0::DOUBLE * list_inner_product(u, w) ORDER BY cls) AS logits
  FROM unit CROSS JOIN class_vec GROUP BY vec_id, target
)"""

RANKED = """
cells AS (SELECT trial, generate_subscripts(logits, 1) - 1 AS cls, unnest(logits) AS logit FROM trials),
weighted AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY trial)) AS e FROM cells),
ranked AS (
  SELECT trial, cls, logit, e / sum(e) OVER (PARTITION BY trial) AS p,
         row_number() OVER (PARTITION BY trial ORDER BY logit DESC, cls) AS r
  FROM weighted
),
tops AS (
  SELECT trial, list(cls ORDER BY r) AS top_idx, list(p ORDER BY r) AS top_p, list(logit ORDER BY r) AS top_l
  FROM ranked WHERE r <= 5 GROUP BY trial
)"""

SEGMENTS = f"""{UNIT},
segs AS (
  SELECT vec_id // 20 AS video, (vec_id % 20) // 2 AS seg, CASE WHEN vec_id % 2 = 0 THEN 'v' ELSE 'a' END AS modality,
         vec_id // 2 AS pair, u
  FROM unit
)"""

CROSS_MODAL = """
cm AS (
  SELECT v.video, v.seg AS row, a.seg AS col, list_inner_product(v.u, a.u) AS sim
  FROM segs v JOIN segs a ON v.video = a.video AND v.modality = 'v' AND a.modality = 'a'
)"""

SYNC_SCORES = """
sync AS (
  SELECT l.doc_id, l.quality::BIGINT AS target, ((d.n_chars * 7919) % 997 + 1) / 999.0::DOUBLE AS prob
  FROM labels l JOIN documents d USING (doc_id)
)"""

CLIPS = """
clips AS (
  SELECT doc_id AS clip_id, source AS video, lang AS label, n_chars AS v_len,
         n_chars * 640 - (doc_id % 7) * 160 AS a_len, 25 AS v_fps, 16000 AS a_fps
  FROM documents
)"""

TOKENS = """
tokens AS (
  SELECT event_id AS token_id, user_id AS video,
         (extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts))::BIGINT AS t0,
         (extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts)
            + 1 + event_id % 8)::BIGINT AS t1,
         floor(value)::BIGINT % 112 AS f0, floor(value)::BIGINT % 112 + 16 AS f1,
         CASE WHEN event_id % 11 = 0 THEN -1
              ELSE list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 END::BIGINT AS cluster,
         event_id % 3 AS parent, value
  FROM events
)"""

HISTORY = """
history AS (
  SELECT event_type AS run, (dayofyear(ts) - 1)::BIGINT AS epoch, round(avg(value), 6) AS metric
  FROM events GROUP BY 1, 2
)"""

LOG_LINES = """
lines AS (
  SELECT event_id AS line_no,
         '12:00:00 | INFO | ' || ['Train', 'Valid', 'Val', 'Eval', 'Test'][event_id % 5 + 1] || ' Epoch: '
         || (dayofyear(ts) - 1) || ' [ ' || (event_id % 977) || '/1000 (5%)]' || chr(9)
         || CASE WHEN event_id % 13 = 0 THEN 'no metric here' ELSE
              'Loss: ' || printf('%.2f', value)
              || CASE WHEN event_id % 2 = 0 THEN ' (' || printf('%.2f', value * 2) || ')' ELSE '' END
              || ' Precision_a: 0.' || (event_id % 10) END AS value
  FROM events
)"""
