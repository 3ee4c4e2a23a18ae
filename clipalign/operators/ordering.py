"""Ranks, running totals and neighbours that never sort one whole group inside one task.

A plain window over ``partitionBy(key)`` sends every row of a key to one task. The helpers below split
the order into slices instead and join the small per-slice totals back:

* ``hash_ranks`` orders by a seeded digest, which is even, so the size of a group says where to cut it;
* ``ordered_slices`` range-partitions on the full order, so even one hot key spreads over many slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clipalign.functions.scalars import seeded_digest
from clipalign.session import broadcast_if_small, materialize

_SLICE = "_slice"
#: Rows of a group that one task sorts, about.
SLICE_ROWS = 50_000
_UPTO_PREVIOUS = (Window.unboundedPreceding, -1)


def digest_slices(df: DataFrame, seed: str, key: str, groups: Sequence[str], size: str, slice_rows: int) -> DataFrame:
    """Add ``_digest``, the place of a row in the seeded shuffle of its group, the group's ``size``, and ``_slice``.

    A digest is spread evenly, so the size of a group alone says where its order is to be cut into slices of about ``slice_rows``: the
    slice is a function of the row and that size, with as many slices as the group needs, and survives a lost executor.
    """
    n = F.count(F.lit(1)).alias(size)
    if groups:
        sized = df.join(broadcast_if_small(df.groupBy(*groups).agg(n)), list(groups))
    else:
        sized = df.withColumn(size, df.agg(n).scalar())
    digest = seeded_digest(seed, F.col(key))
    # 52 bits are exact in a double, and the product rises with them
    share = F.conv(F.substring("_digest", 1, 13), 16, 10).cast("double") / float(1 << 52)
    return sized.withColumn("_digest", digest).withColumn(_SLICE, F.floor(share * F.ceil(F.col(size) / F.lit(slice_rows))))


def hash_ranks(
    df: DataFrame, seed: str, key: str, groups: Sequence[str] = (), rank: str = "rank", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Add the 1-based position of each row in the seeded shuffle of its group, and the group size.

    ``key`` is unique within a group. A group is cut by digest into slices of about ``slice_rows`` rows.
    """
    shuffled = digest_slices(df, seed, key, groups, f"{rank}_of", slice_rows)
    sizes = shuffled.groupBy(*groups, _SLICE).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*groups).orderBy(_SLICE)
    offsets = sizes.select(*groups, _SLICE, F.coalesce(F.sum("_n").over(order.rowsBetween(*_UPTO_PREVIOUS)), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*groups, _SLICE).orderBy("_digest", key)
    ranked = shuffled.join(offsets, [*groups, _SLICE]).withColumn(
        rank, F.row_number().over(within).cast("bigint") + F.col("_before")
    )
    return ranked.drop("_digest", _SLICE, "_before")


def hash_first(
    df: DataFrame, seed: str, key: str, groups: Sequence[str], quota: int | DataFrame, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """The first rows of each group in its seeded shuffle: ``quota`` rows, or as many as a table says per group.

    Only the slices of the digest that can hold such rows are ranked, so a small quota shuffles few rows.
    ``quota`` as a table has the group columns and ``quota``.
    """
    shuffled = digest_slices(df, seed, key, groups, "_of", slice_rows)
    sizes = shuffled.groupBy(*groups, _SLICE).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*groups).orderBy(_SLICE).rowsBetween(*_UPTO_PREVIOUS)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    if isinstance(quota, DataFrame):
        offsets = offsets.join(quota, list(groups))
    else:
        offsets = offsets.withColumn("quota", F.lit(quota))
    needed = offsets.where(F.col("_before") < F.col("quota")).withColumnRenamed("quota", "_quota")
    near = shuffled.join(broadcast_if_small(needed), [*groups, _SLICE])
    within = Window.partitionBy(*groups, _SLICE).orderBy("_digest", key)
    ranked = near.withColumn("_rank", F.row_number().over(within) + F.col("_before"))
    return ranked.where(F.col("_rank") <= F.col("_quota")).select(*df.columns)


def ordered_slices(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-partition by the order, number the partitions in ``_slice`` and fix the result by checkpoint."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn(_SLICE, F.spark_partition_id()))


def running_totals(
    df: DataFrame, order: Sequence[Column | str], measures: Mapping[str, Column], groups: Sequence[str] = ()
) -> DataFrame:
    """Add inclusive running sums per group in the given order, which must be total."""
    group_order = [F.col(g) for g in groups]
    sliced = ordered_slices(df, [*group_order, *order])
    local = Window.partitionBy(_SLICE, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = sliced.groupBy(_SLICE, *groups).agg(*[F.sum(m).alias(f"_t_{n}") for n, m in measures.items()])
    before = Window.partitionBy(*groups).orderBy(_SLICE).rowsBetween(*_UPTO_PREVIOUS)
    offsets = totals.select(
        _SLICE, *groups, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in measures]
    )
    summed = sliced.select("*", *[F.sum(m).over(local).alias(f"_l_{n}") for n, m in measures.items()])
    joined = summed.join(offsets, [_SLICE, *groups])
    for name in measures:
        joined = joined.withColumn(name, F.col(f"_l_{name}") + F.col(f"_b_{name}"))
    return joined.drop(_SLICE, *[f"_l_{n}" for n in measures], *[f"_b_{n}" for n in measures])


def row_numbers(
    df: DataFrame, order: Sequence[Column | str], groups: Sequence[str] = (), rank: str = "rank"
) -> DataFrame:
    """Add the 1-based row number per group in the given total order.

    The position inside a slice comes from the sort itself, so the rows are shuffled once; what is joined
    back has one row per slice and group.
    """
    full_order = [*[F.col(g) for g in groups], *order]
    ranged = df.repartitionByRange(*full_order).sortWithinPartitions(*full_order)
    # the low 33 bits of the id count the rows of a partition
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sliced = materialize(ranged.withColumn(_SLICE, F.spark_partition_id()).withColumn("_pos", within))
    parts = sliced.groupBy(_SLICE, *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy(_SLICE).rowsBetween(*_UPTO_PREVIOUS))
    shifts = parts.select(_SLICE, *groups, (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    joined = sliced.join(broadcast_if_small(shifts), [_SLICE, *groups])
    return joined.withColumn(rank, F.col("_pos") + F.col("_shift")).drop(_SLICE, "_pos", "_shift")


def neighbours(
    df: DataFrame, order: Sequence[Column | str], values: Mapping[str, str], groups: Sequence[str] = ()
) -> DataFrame:
    """Add ``prev_<name>`` and ``next_<name>`` of each value column within its group."""
    sliced = ordered_slices(df, [*[F.col(g) for g in groups], *order])
    local = Window.partitionBy(_SLICE, *groups).orderBy(*order)
    ranked = sliced.withColumn("_row", F.row_number().over(local))
    packed = F.struct(*[F.col(c) for c in values.values()])
    edges = ranked.groupBy(_SLICE, *groups).agg(
        F.min_by(packed, "_row").alias("_first"), F.max_by(packed, "_row").alias("_last")
    )
    across = Window.partitionBy(*groups).orderBy(_SLICE)
    edges = edges.select(
        _SLICE, *groups, F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after")
    )
    joined = ranked.join(edges, [_SLICE, *groups])
    for name, source in values.items():
        joined = joined.withColumn(
            f"prev_{name}", F.coalesce(F.lag(source).over(local), F.col("_before")[source])
        ).withColumn(f"next_{name}", F.coalesce(F.lead(source).over(local), F.col("_after")[source]))
    return joined.drop(_SLICE, "_row", "_before", "_after")


def carry_last(
    df: DataFrame, order: Sequence[Column | str], value: str, groups: Sequence[str] = (), held: str = "held"
) -> DataFrame:
    """Add the latest non-null value at or before each row of its group."""
    sliced = ordered_slices(df, [*[F.col(g) for g in groups], *order])
    local = Window.partitionBy(_SLICE, *groups).orderBy(*order)
    ranked = sliced.withColumn("_row", F.row_number().over(local))
    ends = ranked.groupBy(_SLICE, *groups).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_row"))).alias("_end")
    )
    before = Window.partitionBy(*groups).orderBy(_SLICE).rowsBetween(*_UPTO_PREVIOUS)
    ends = ends.select(_SLICE, *groups, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    here = F.last(value, ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, 0))
    joined = ranked.withColumn(held, here).join(ends, [_SLICE, *groups])
    return joined.withColumn(held, F.coalesce(held, "_carried")).drop(_SLICE, "_row", "_carried")


def known_around(
    df: DataFrame, order: Sequence[Column | str], value: str, groups: Sequence[str] = ()
) -> DataFrame:
    """Add ``prev_known`` and ``next_known``: the nearest non-null values at or before and at or after each row."""
    sliced = ordered_slices(df, [*[F.col(g) for g in groups], *order])
    local = Window.partitionBy(_SLICE, *groups).orderBy(*order)
    ranked = sliced.withColumn("_row", F.row_number().over(local))
    known_row = F.when(F.col(value).isNotNull(), F.col("_row"))
    ends = ranked.groupBy(_SLICE, *groups).agg(
        F.min_by(value, known_row).alias("_begin"), F.max_by(value, known_row).alias("_end"))
    across = Window.partitionBy(*groups).orderBy(_SLICE)
    backwards = Window.partitionBy(*groups).orderBy(F.col(_SLICE).desc())
    ends = ends.select(
        _SLICE, *groups,
        F.last("_end", ignorenulls=True).over(across.rowsBetween(*_UPTO_PREVIOUS)).alias("_carried"),
        F.last("_begin", ignorenulls=True).over(backwards.rowsBetween(*_UPTO_PREVIOUS)).alias("_coming"))
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    # the same growing frame in reverse order; a frame that ends at the last row would be summed anew per row
    back = Window.partitionBy(_SLICE, *groups).orderBy(F.col("_row").desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranked.withColumn("prev_known", F.last(value, ignorenulls=True).over(upto)).withColumn(
        "next_known", F.last(value, ignorenulls=True).over(back)).join(ends, [_SLICE, *groups])
    return joined.withColumn("prev_known", F.coalesce("prev_known", "_carried")).withColumn(
        "next_known", F.coalesce("next_known", "_coming")).drop(_SLICE, "_row", "_carried", "_coming")


def cumulative_counts(df: DataFrame, value: str, groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Distinct values per group with their count ``n``, or the sum of a whole-number weight, and the running ``upto``."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(n.alias("n"))
    return running_totals(counts, [F.col(value)], {"upto": F.col("n")}, groups)


def exact_quantiles(
    df: DataFrame, value: str, quantiles: Mapping[str, float], groups: Sequence[str] = (), nearest: Sequence[str] = (),
    figures: Mapping[str, Column] | None = None, weight: str | None = None,
) -> DataFrame:
    """Exact quantiles per group, interpolated between neighbours, or at the nearest index for ``nearest``.

    Works on running counts of the distinct values, so no task holds all values of a group. ``figures`` are
    further aggregates over the distinct values, weighted by their count ``n``. With ``weight``, a row counts that often.
    """
    keys = list(groups) or ["_all"]
    if not groups:
        df = df.withColumn("_all", F.lit(1))
    runs = cumulative_counts(df, value, keys, weight)
    sizes = runs.groupBy(*keys).agg(F.sum("n").alias("_size"))
    placed = runs.join(broadcast_if_small(sizes), keys)
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    picks = []
    for name, q in quantiles.items():
        position = (F.col("_size") - 1) * F.lit(float(q))
        low = F.bround(position) if name in nearest else F.floor(position)
        high = low if name in nearest else F.ceil(position)
        picks += [
            F.max(F.when((first <= low) & (low <= last), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((first <= high) & (high <= last), F.col(value))).alias(f"_hi_{name}"),
        ]
    picked = placed.groupBy(*keys).agg(
        F.max("_size").alias("_size"), *picks, *[c.alias(name) for name, c in (figures or {}).items()])
    outputs = []
    for name, q in quantiles.items():
        position = (F.col("_size") - 1) * F.lit(float(q))
        part = position - F.floor(position)
        blend = F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * part
        outputs.append((F.col(f"_lo_{name}") if name in nearest else blend).alias(name))
    return picked.select(*groups, *outputs, *(figures or {}))
