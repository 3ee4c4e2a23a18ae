"""Token clustering and colour embedding with MLlib; the spectral form uses a fixed set of landmarks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from clipalign.functions import scalars, vectors
from clipalign.operators.ordering import hash_first, row_numbers, running_totals
from clipalign.operators.sampling import cluster_stratified_sample
from clipalign.operators.similarity import mean_vector
from clipalign.operators.tokens import UNASSIGNED
from clipalign.session import broadcast_if_small, materialize

# Fixed value: the colour of a single cluster.
ONLY_COLOR = (1.0, 0.2, 0.2)


def standardize_pca_l2(df: DataFrame, feature: str, dims: int = 64) -> DataFrame:
    """Z-score, project on at most ``dims`` principal components where there are more, scale to length one."""
    width = df.select(F.size(feature)).head()[0]
    vec = df.withColumn("_x", array_to_vector(vectors.as_double(F.col(feature))))
    scaled = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(vec).transform(vec)
    if width > dims:
        scaled = PCA(k=dims, inputCol="_z", outputCol="_p").fit(scaled).transform(scaled)
    else:
        scaled = scaled.withColumn("_p", F.col("_z"))
    unit = Normalizer(inputCol="_p", outputCol="_u", p=2.0).transform(scaled)
    return unit.withColumn("embedded", vector_to_array("_u")).drop("_x", "_z", "_p", "_u")


def landmark_embedding(df: DataFrame, feature: str, key: str, n_eig: int, seed: str, landmarks: int = 256) -> DataFrame:
    """Leading eigenvectors of the normalised affinity of all tokens, extended from a seeded sample of ``landmarks`` tokens.

    Only the landmarks are gathered to solve their own problem, whose work grows with their cube; every token is then placed by its
    affinity to them, so the rest grows with the tokens alone. The caller chooses how many landmarks the tokens need.
    """
    unit = df.withColumn("_u", vectors.l2_normalize(vectors.as_double(F.col(feature))))
    chosen = unit.select(key, "_u").orderBy(scalars.seeded_digest(seed, F.col(key)), key).limit(landmarks)
    marks = np.array([row["_u"] for row in chosen.select("_u").collect()])
    affinity = np.exp(marks @ marks.T - 1.0)
    root = 1.0 / np.sqrt(affinity.sum(axis=1))
    values, basis = np.linalg.eigh(affinity * root[:, None] * root[None, :])
    top = np.argsort(values)[::-1][:n_eig]
    projection = root[:, None] * basis[:, top] / values[top]

    schema = StructType([*df.schema.fields, StructField("eigen", ArrayType(DoubleType()))])
    names = df.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = np.exp(np.stack(batch["_u"].to_numpy()) @ marks.T - 1.0)
            placed = (near / np.sqrt(near.sum(axis=1, keepdims=True))) @ projection
            yield batch[names].assign(eigen=list(placed))

    return unit.mapInPandas(place, schema)


def token_clusters(
    df: DataFrame, feature: str, key: str, k: int, seed: int, method: str = "kmeans", n_eig: int = 8, landmarks: int = 256
) -> DataFrame:
    """Add ``cluster``. ``spectral`` clusters the leading eigenvectors, ``kmeans`` the normalised features."""
    if method == "spectral":
        placed = landmark_embedding(df, feature, key, n_eig, str(seed), landmarks)
        source = F.col("eigen")
    elif method == "kmeans":
        placed, source = df, vectors.l2_normalize(vectors.as_double(F.col(feature)))
    else:
        raise ValueError(f"unknown clustering method {method}")
    prepared = materialize(placed.withColumn("_x", array_to_vector(source)))
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(prepared)
    return model.transform(prepared).drop("_x", "eigen").withColumn("cluster", F.col("cluster").cast("bigint"))


def separate_layer_clusters(df: DataFrame, layers: Sequence[str], feature: str, key: str, k: int, seed: int) -> DataFrame:
    """One independent model per layer; the few layers are named by the caller."""
    parts = [token_clusters(df.where(F.col("layer") == name), feature, key, k, seed) for name in layers]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def layer_offsets(df: DataFrame, clip: str, layers: Sequence[str], shared: bool = False) -> DataFrame:
    """``start`` and ``stop`` of each clip's and place's rows among the tokens that are clustered together.

    Clips come in order, and the chosen layers of a clip one after the other, so a layer that is chosen twice has two places. With
    ``shared`` all layers of a clip stand for the same rows, those of its windows.
    """
    counts = _placed(df, layers).groupBy(clip, "place", "layer").agg(F.count(F.lit(1)).alias("n"))
    if shared:
        ends = running_totals(counts.where("place = 0").select(clip, "n"), [F.col(clip)], {"stop": F.col("n")})
        found = counts.drop("n").join(ends, clip)
    else:
        found = running_totals(counts, [F.col(clip), F.col("place")], {"stop": F.col("n")})
    return found.select(clip, "place", "layer", (F.col("stop") - F.col("n")).alias("start"), "stop")


def _placed(df: DataFrame, layers: Sequence[str]) -> DataFrame:
    """A row of each token for every place that its layer has in the list; tokens of other layers have none."""
    listed = F.array(*[F.struct(F.lit(i).cast("bigint").alias("place"), F.lit(name).alias("name")) for i, name in enumerate(layers)])
    places = F.transform(F.filter(listed, lambda x: x["name"] == F.col("layer")), lambda x: x["place"])
    return df.withColumn("place", F.explode(places))


def joint_layer_clusters(
    df: DataFrame, layers: Sequence[str], feature: str, key: str, k: int, seed: int, dims: int = 64, **how
) -> DataFrame:
    """One model over the tokens of all chosen layers: ``place`` in the list, ``layer`` and ``cluster`` of every token.

    Features are standardised over all of them together, so the clusters can be compared from layer to layer.
    """
    placed = _placed(df, layers).withColumn("_token", F.concat_ws(":", F.col(key).cast("string"), "place"))
    embedded = standardize_pca_l2(placed, feature, max(dims, k))
    return token_clusters(embedded, "embedded", "_token", k, seed, **how).drop("_token", "embedded")


def concat_layer_features(df: DataFrame, clip: str, window: str, layers: Sequence[str], feature: str) -> DataFrame:
    """One row per window: the features of the chosen layers, one after the other. A window that a layer lacks is refused."""
    of_layer = [F.max_by(feature, F.when(F.col("layer") == name, F.lit(1))) for name in dict.fromkeys(layers)]
    rows = df.where(F.col("layer").isin(list(layers))).groupBy(clip, window).agg(
        *[c.alias(f"_l{i}") for i, c in enumerate(of_layer)])
    columns = {name: F.col(f"_l{i}") for i, name in enumerate(dict.fromkeys(layers))}
    lacking = F.concat(F.lit("a layer has no token in window "), F.col(window).cast("string"), F.lit(" of "), F.col(clip).cast("string"))
    whole = F.when(F.greatest(*[c.isNull() for c in columns.values()], F.lit(False)), F.raise_error(lacking).cast("array<double>"))
    return rows.select(clip, window, whole.otherwise(F.concat(*[vectors.as_double(columns[name]) for name in layers])).alias(feature))


def concat_layer_clusters(
    df: DataFrame, layers: Sequence[str], clip: str, window: str, feature: str, k: int, seed: int, dims: int = 64, **how
) -> DataFrame:
    """One model over windows, each with the features of all chosen layers: ``cluster`` of every token of these layers.

    All layers of a window share its cluster.
    """
    windows = concat_layer_features(df, clip, window, layers, feature).withColumn("_token", F.concat_ws(":", F.col(clip).cast("string"), F.col(window).cast("string")))
    embedded = standardize_pca_l2(windows, feature, max(dims, k))
    labels = token_clusters(embedded, "embedded", "_token", k, seed, **how).select(clip, window, "cluster")
    return _placed(df, layers).join(labels, [clip, window])


def grouped_clusters(
    df: DataFrame, group: str, feature: str, key: str, k: int, seed: str, iterations: int | None = None, tolerance: float = 1e-9
) -> DataFrame:
    """K-means inside every group at once: centroids are a table keyed by group, tokens never gather.

    Starts from the first ``k`` tokens of each group's seeded order. A round joins the group's ``k``
    centroids to its tokens and averages on the map side. Rounds go on until no coordinate moves by more than
    ``tolerance``, or for as many ``iterations`` as the caller allows.
    """
    points = materialize(df.withColumn("_u", vectors.l2_normalize(vectors.as_double(F.col(feature)))))
    width = points.select(F.size("_u")).head()[0]
    firsts = hash_first(points.select(group, key, "_u"), seed, key, [group], k)
    numbered = Window.partitionBy(group).orderBy(scalars.seeded_digest(seed, F.col(key)))  # k rows per group
    centers = firsts.select(group, (F.row_number().over(numbered) - 1).alias("cluster"), F.col("_u").alias("center"))

    def assign(current: DataFrame) -> DataFrame:
        packed = current.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("_centers"))
        gaps = F.transform("_centers", lambda c: F.struct(
            F.aggregate(F.zip_with("_u", c["center"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("gap"),
            c["cluster"].alias("cluster")))
        return points.join(broadcast_if_small(packed, row_bytes=k * width * 8), group).withColumn(
            "cluster", F.array_min(gaps)["cluster"]).drop("_centers")

    done, rounds = False, 0
    while not done and (iterations is None or rounds < iterations):
        moved = assign(centers).groupBy(group, "cluster").agg(mean_vector(F.col("_u")).alias("_moved"))
        step = materialize(centers.join(moved, [group, "cluster"], "left").select(
            group, "cluster", F.coalesce("_moved", "center").alias("_next"), "center"))
        shift = F.array_max(F.zip_with("_next", "center", lambda a, b: F.abs(a - b)))
        done = step.where(shift > tolerance).isEmpty()
        centers = step.select(group, "cluster", F.col("_next").alias("center"))
        rounds += 1
    return assign(centers).drop("_u")


def recursive_clusters(
    df: DataFrame, parents: Sequence[int], feature: str, key: str, k: int, seed: int, method: str = "kmeans"
) -> DataFrame:
    """Cluster the tokens of the chosen parent clusters again; all other tokens get the unassigned mark."""
    chosen = df.where(F.col("parent").isin(list(parents)))
    again = token_clusters(chosen, feature, key, k, seed, method).select(key, "cluster")
    return df.join(again, key, "left").fillna(UNASSIGNED, ["cluster"])


def cluster_colors(points: DataFrame, cluster: str, feature: str, n_clusters: int | None = None) -> DataFrame:
    """Colour per cluster: three principal components of the centroids, scaled between their 2 and 98 percent points.

    With ``n_clusters``, ids below it that have no points get a colour too, from a centroid of zeros. A single cluster has a fixed colour.
    One row per cluster from the start on, so percentiles and windows stay small.
    """
    centroids = points.groupBy(cluster).agg(mean_vector(vectors.as_double(F.col(feature))).alias("_c"))
    if n_clusters is not None:
        width = F.lit(points.select(F.size(feature)).head()[0])
        every = points.sparkSession.range(n_clusters).select(F.col("id").alias(cluster))
        centroids = every.join(centroids, cluster, "left").withColumn("_c", F.coalesce("_c", F.array_repeat(F.lit(0.0), width)))
    centroids = materialize(centroids)
    if len(centroids.head(2)) < 2:
        rgb = centroids.select(cluster, *[F.lit(v).alias(c) for c, v in zip("rgb", ONLY_COLOR)])
        return rgb.withColumn("hex", scalars.rgb_hex(F.col("r"), F.col("g"), F.col("b")))
    vec = centroids.withColumn("_x", array_to_vector("_c"))
    projected = PCA(k=3, inputCol="_x", outputCol="_p").fit(vec).transform(vec).withColumn("_p", vector_to_array("_p"))
    axes = projected.select(cluster, *[F.get("_p", F.lit(i)).alias(a) for i, a in enumerate("xyz")])
    bounds = axes.agg(F.struct(*[
        F.percentile(a, F.array(F.lit(0.02), F.lit(0.98))).alias(a) for a in "xyz"]).alias("b")).scalar()
    shown = axes.withColumn("_b", bounds)
    colors = []
    for axis, channel in zip("xyz", "rgb"):
        low, high = F.get(f"_b.{axis}", F.lit(0)), F.get(f"_b.{axis}", F.lit(1))
        part = (F.col(axis) - low) / F.greatest(high - low, F.lit(1e-6))
        colors.append((F.lit(0.15) + F.lit(0.85) * scalars.clamp(part, F.lit(0.0), F.lit(1.0))).alias(channel))
    rgb = shown.select(cluster, *colors)
    return rgb.withColumn("hex", scalars.rgb_hex(F.col("r"), F.col("g"), F.col("b")))


def point_table(df: DataFrame, key: str, cluster: str, feature: str, size: int, seed: str) -> DataFrame:
    """Cluster-stratified sample with two principal components and a plot row in key order."""
    sampled = materialize(cluster_stratified_sample(df, key, cluster, size, seed))
    vec = sampled.withColumn("_x", array_to_vector(vectors.as_double(F.col(feature))))
    projected = PCA(k=2, inputCol="_x", outputCol="_p").fit(vec).transform(vec).withColumn("_p", vector_to_array("_p"))
    shown = projected.withColumn("x", F.get("_p", F.lit(0))).withColumn("y", F.get("_p", F.lit(1))).drop("_x", "_p", feature)
    return row_numbers(shown, [F.col(key)], rank="plot_row").withColumn("plot_row", F.col("plot_row") - 1)
