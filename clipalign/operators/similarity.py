"""Cosine matrices, alignment scores, retrieval and zero-shot classification over feature arrays.

A matrix never spans more than one chunk of ``n_segments`` positions of a clip or one batch of
``batch_size`` pairs, so the pairs per row are bounded however long a clip or a corpus grows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from clipalign.functions import vectors


def mean_vector(feature: Column) -> Column:
    """Aggregate: element-wise mean, combined on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(feature)))


def class_vectors(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Mean of the normalised vectors per class, normalised again."""
    unit = df.select(label, vectors.l2_normalize(F.col(feature)).alias("_unit"))
    return unit.groupBy(F.col(label).alias("cls")).agg(mean_vector(F.col("_unit")).alias("weight")).select(
        "cls", vectors.l2_normalize(F.col("weight")).alias("weight")
    )


def zero_shot_logits(
    samples: DataFrame,
    references: DataFrame,
    feature: str = "feat",
    label: str = "target",
    scale: float = 100.0,
) -> DataFrame:
    """Add ``logits``: scaled cosine to every class vector, in class order; null without a feature.

    A row holds a logit per class, so the class vectors are as few as a row can hold. They are gathered and multiplied with whole
    Arrow batches, which measures many times faster than lambdas over arrays. Classes may be of any type that sorts.
    """
    weights = class_vectors(references.where(F.col(feature).isNotNull() & F.col(label).isNotNull()), feature, label)
    matrix = np.array([row["weight"] for row in weights.orderBy("cls").collect()])
    return samples.withColumn("logits", _matrix_logits(matrix, scale)(F.col(feature)))


def _matrix_logits(matrix: np.ndarray, scale: float) -> Callable[[Column], Column]:
    def multiply(features: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(features)
        there = np.flatnonzero(features.notna())
        if len(there) and len(matrix):
            stacked = np.stack(features.iloc[there].to_numpy()).astype(np.float64)
            unit = stacked / np.maximum(np.linalg.norm(stacked, axis=1, keepdims=True), 1e-12)
            for i, logits in zip(there, unit @ matrix.T * scale):
                out[i] = logits
        return pd.Series(out, dtype=object)

    return F.pandas_udf(multiply, ArrayType(DoubleType()))


def similarity_matrices(segments: DataFrame, n_segments: int, scale: float = 1.0) -> DataFrame:
    """Long-form cosine matrices ``v2a``, ``a2v``, ``v2v`` and ``a2a`` of every chunk of a clip."""
    unit = _chunked(segments, n_segments)
    rows = unit.select("video", "chunk", F.col("modality").alias("rm"), F.col("seg").alias("row"), F.col("u").alias("x"))
    cols = unit.select("video", "chunk", F.col("modality").alias("cm"), F.col("seg").alias("col"), F.col("u").alias("y"))
    computed = (
        rows.join(cols, ["video", "chunk"])
        .where((F.col("rm") == "v") | (F.col("cm") == "a"))
        .withColumn("sim", vectors.dot(F.col("x"), F.col("y")) / scale)
    )
    direct = F.struct(F.concat("rm", F.lit("2"), "cm").alias("kind"), F.col("row"), F.col("col"), "sim")
    transposed = F.struct(F.lit("a2v").alias("kind"), F.col("col").alias("row"), F.col("row").alias("col"), "sim")
    crossing = F.col("rm") != F.col("cm")
    cells = F.when(crossing, F.array(direct, transposed)).otherwise(F.array(direct))
    return computed.select("video", "chunk", F.inline(cells))


def _chunked(segments: DataFrame, n_segments: int) -> DataFrame:
    return segments.select(
        "video",
        F.floor(F.col("seg") / n_segments).alias("chunk"),
        (F.col("seg") % n_segments).alias("seg"),
        "modality",
        vectors.l2_normalize(F.col("feat")).alias("u"),
    )


def cross_modal(segments: DataFrame, n_segments: int) -> DataFrame:
    """Only the visual-to-audio cells: ``row`` is the visual and ``col`` the audio segment."""
    unit = _chunked(segments, n_segments)
    v = unit.where("modality = 'v'").select("video", "chunk", F.col("seg").alias("row"), F.col("u").alias("x"))
    a = unit.where("modality = 'a'").select("video", "chunk", F.col("seg").alias("col"), F.col("u").alias("y"))
    return v.join(a, ["video", "chunk"]).select(
        "video", "chunk", "row", "col", vectors.dot(F.col("x"), F.col("y")).alias("sim")
    )


def row_minmax(cells: DataFrame, row_keys: Sequence[str], value: str = "sim", eps: float = 1e-12) -> DataFrame:
    """Scale every matrix row to [0, 1]; a row is at most one chunk wide."""
    row = Window.partitionBy(*row_keys)
    low, high = F.min(value).over(row), F.max(value).over(row)
    return cells.withColumn("scaled", (F.col(value) - low) / F.greatest(high - low, F.lit(eps)))


def row_softmax(cells: DataFrame, row_keys: Sequence[str], value: str = "sim") -> DataFrame:
    row = Window.partitionBy(*row_keys)
    shifted = cells.withColumn("_e", F.exp(F.col(value) - F.max(value).over(row)))
    return shifted.withColumn("prob", F.col("_e") / F.sum("_e").over(row)).drop("_e")


def alignment_scores(segments: DataFrame, n_segments: int, temperature: float = 0.07) -> DataFrame:
    """How strongly each visual segment prefers its own audio segment, per chunk of a clip."""
    keys = ["video", "chunk"]
    sizes = _chunked(segments, n_segments).groupBy(*keys).agg(
        F.least(F.count_if(F.col("modality") == "v"), F.count_if(F.col("modality") == "a")).alias("n")
    )
    cells = cross_modal(segments, n_segments).join(sizes, keys).where("row < n and col < n")
    on_diag = F.col("row") == F.col("col")
    weight = F.exp((F.col("sim") - 1.0) / temperature)
    rows = cells.groupBy(*keys, "row").agg(
        F.first("n").alias("n"),
        F.max(F.when(on_diag, F.col("sim"))).alias("diag"),
        F.max(F.when(~on_diag, F.col("sim"))).alias("rival"),
        F.max_by("col", F.struct("sim", -F.col("col"))).alias("best"),
        F.sum(F.when(on_diag, weight)).alias("own"),
        F.sum(weight).alias("mass"),
    )
    return rows.groupBy(*keys).agg(
        F.avg(F.col("diag") - F.coalesce("rival", F.lit(0.0))).alias("diag_margin"),
        F.avg(F.col("own") / F.col("mass")).alias("diag_prob"),
        F.avg((F.col("best") == F.col("row")).cast("double")).alias("row_acc"),
        F.avg("diag").alias("diag_mean"),
        F.first("n").alias("n_segments"),
    )


def shifted_window_retrieval(segments: DataFrame, n_segments: int, width: int) -> DataFrame:
    """Match windows of ``width`` segments across modalities; precision is the share matched in place.

    The flattened window product is the sum of the cell products along one diagonal.
    """
    keys = ["video", "chunk"]
    cells = cross_modal(segments, n_segments).withColumn("_diag", F.col("row") - F.col("col"))
    along = Window.partitionBy(*keys, "_diag").orderBy("row").rowsBetween(0, width - 1)
    windows = (
        cells.withColumn("score", F.sum("sim").over(along))
        .withColumn("_full", F.count("sim").over(along))
        .where(F.col("_full") == width)
    )
    best_a = windows.groupBy(*keys, F.col("row").alias("pos")).agg(
        F.max_by("col", F.struct("score", -F.col("col"))).alias("hit"))
    best_v = windows.groupBy(*keys, F.col("col").alias("pos")).agg(
        F.max_by("row", F.struct("score", -F.col("row"))).alias("hit"))
    sides = best_a.withColumn("side", F.lit("a")).unionByName(best_v.withColumn("side", F.lit("v")))
    match = (F.col("hit") == F.col("pos")).cast("double")
    return sides.groupBy(*keys).agg(
        F.avg(F.when(F.col("side") == "a", match)).alias("precision_a"),
        F.avg(F.when(F.col("side") == "v", match)).alias("precision_v"),
    ).withColumn("precision", (F.col("precision_a") + F.col("precision_v")) / 2)


def batch_cells(pairs: DataFrame, batch_size: int, features: Sequence[str] = ("feat",)) -> DataFrame:
    """All visual-audio products inside each batch of pairs; one ``sim`` column per feature column."""
    batched = pairs.withColumn("batch", F.floor(F.col("pair") / batch_size))
    v = batched.where("modality = 'v'").select(
        "batch", F.col("pair").alias("row"), *[F.col(f).alias(f"_v_{f}") for f in features])
    a = batched.where("modality = 'a'").select(
        "batch", F.col("pair").alias("col"), *[F.col(f).alias(f"_a_{f}") for f in features])
    sims = [vectors.dot(F.col(f"_v_{f}"), F.col(f"_a_{f}")).alias(f"sim_{f}") for f in features]
    return v.join(a, "batch").select("batch", "row", "col", *sims)


def retrieval_metrics(pairs: DataFrame, batch_size: int) -> DataFrame:
    """Rank of the true partner in both directions: mean, floored median and recall at 1, 5 and 10."""
    cells = batch_cells(pairs, batch_size).withColumnRenamed("sim_feat", "sim")
    sides = cells.select("batch", F.inline(F.array(
        F.struct(F.lit("v2a").alias("direction"), F.col("row").alias("query"), F.col("col").alias("item"), "sim"),
        F.struct(F.lit("a2v").alias("direction"), F.col("col").alias("query"), F.col("row").alias("item"), "sim"),
    )))
    row = ["batch", "direction", "query"]
    own = F.max(F.when(F.col("query") == F.col("item"), F.col("sim"))).over(Window.partitionBy(*row))
    ahead = (F.col("sim") > F.col("own")) | ((F.col("sim") == F.col("own")) & (F.col("item") < F.col("query")))
    ranks = sides.withColumn("own", own).groupBy(*row).agg(F.count_if(ahead).alias("rank"))
    return ranks.groupBy("batch", "direction").agg(
        (F.avg("rank") + 1).alias("mean_rank"),
        (F.floor(F.percentile("rank", F.lit(0.5))) + 1).cast("bigint").alias("median_rank"),
        *[F.avg((F.col("rank") < k).cast("double")).alias(f"recall_at_{k}") for k in (1, 5, 10)],
    )


def nearest_segments(
    segments: DataFrame, chosen: Column, k: int, key: str = "segment", kind: str = "modality", feature: str = "feat",
    block_rows: int = 20_000, digits: int = 9,
) -> DataFrame:
    """The ``k`` most similar segments of each kind, over all clips, for every chosen segment: ``segment``, ``kind`` (as in ``v2a``),
    ``rank`` from 1, ``partner`` and ``sim``.

    Chosen rows and all rows are dealt to blocks of about ``block_rows``; each pair of blocks is one matrix product, of which only the
    ``k`` best columns of a row and kind go on. So no task holds more than two blocks, and no more than ``k`` partners per block are
    shuffled again, where a partial top-k comes before the exchange. Cosines are compared after rounding to ``digits``; of equal ones
    the smaller key comes first. A segment is no partner of its own. Rows without a feature take no part.
    """
    unit = segments.where(F.col(feature).isNotNull()).select(
        F.col(key).alias("key"), F.col(kind).alias("kind"), vectors.l2_normalize(vectors.as_double(F.col(feature))).alias("u"), chosen.alias("_chosen"))
    sizes = unit.agg(F.count(F.lit(1)).alias("n"), F.count_if("_chosen").alias("m")).head()
    n_blocks, m_blocks = (max(1, -(-n // block_rows)) for n in (sizes["n"], sizes["m"]))
    dealt = F.xxhash64("key")
    columns = F.explode(F.sequence(F.lit(0), F.lit(m_blocks - 1)))
    rows = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    asked = unit.where("_chosen").select("key", "kind", "u", F.pmod(dealt, F.lit(m_blocks)).cast("int").alias("qb"), rows.alias("ib"))
    held = unit.select("key", "kind", "u", F.pmod(dealt, F.lit(n_blocks)).cast("int").alias("ib"), columns.alias("qb"))
    key_type = unit.schema["key"].dataType.simpleString()
    found = asked.groupBy("qb", "ib").cogroup(held.groupBy("qb", "ib")).applyInPandas(
        _best_of_block(k, digits), f"segment {key_type}, kind string, partner {key_type}, sim double")
    order = Window.partitionBy("segment", "kind").orderBy(F.col("sim").desc(), "partner")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    return ranked.select("segment", "kind", "rank", "partner", "sim")


def _best_of_block(k: int, digits: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        segments, kinds, partners, values = [], [], [], []
        if len(asked):
            queries = np.stack(asked["u"].to_numpy())
            # rising keys, so that a stable sort leaves the smaller of equals in front
            for kind, mine in held.sort_values("key").groupby("kind"):
                keys, matrix = mine["key"].to_numpy(), np.stack(mine["u"].to_numpy())
                # some rows at a time: the product never outgrows the blocks themselves
                step = max(1, matrix.size // len(keys))
                for at in range(0, len(queries), step):
                    own = asked.iloc[at:at + step]
                    sims = np.round(queries[at:at + step] @ matrix.T, digits)
                    sims[own["key"].to_numpy()[:, None] == keys[None, :]] = -np.inf
                    if len(keys) > k:
                        least = np.partition(sims, -k, axis=1)[:, -k]
                    else:
                        least = np.full(len(sims), -np.inf)
                    for i, (segment, own_kind) in enumerate(zip(own["key"], own["kind"])):
                        near = np.flatnonzero((sims[i] >= least[i]) & (sims[i] > -np.inf))
                        near = near[np.argsort(-sims[i][near], kind="stable")[:k]]
                        segments += [segment] * len(near)
                        kinds += [f"{own_kind}2{kind}"] * len(near)
                        partners += keys[near].tolist()
                        values += sims[i][near].tolist()
        of_key = held["key"].dtype
        return pd.DataFrame({"segment": pd.Series(segments, dtype=of_key), "kind": pd.Series(kinds, dtype=object),
                             "partner": pd.Series(partners, dtype=of_key), "sim": pd.Series(values, dtype=float)})

    return best
