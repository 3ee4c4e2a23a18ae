"""Mixing sources to target weights by Pfair scheduling.

Documents of a source come in digest order, in blocks. A source of weight w in a period of L slots may place its block k not before
floor(k L / w) and must place it before ceil((k + 1) L / w); in every slot the released block with the earliest deadline goes. So the
blocks of a source placed in any first t slots differ by less than one from t w / L. The schedule repeats after L slots, so a block's
slot follows from its number alone. A source that has run out leaves its slots empty, and the others keep their order.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, functions as F, Window as W

from .sharding import digest_bits

#: Documents in a block.
BLOCK = 64
#: Rows of a slice of the digest that are ranked together, and slices whose counts are summed together.
SLICE_ROWS = 1000
SUPER = 1000
REST = "(rest)"


def slots(weights: dict[str, int]) -> dict[str, list[int]]:
    """For each source, the slots of its blocks in one period: earliest deadline first among the released."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive whole numbers")
    period = sum(weights.values())
    placed: dict[str, list[int]] = {s: [] for s in weights}
    for t in range(period):
        released = [(-(-(len(placed[s]) + 1) * period // w), i, s) for i, (s, w) in enumerate(weights.items())
                    if len(placed[s]) < w and len(placed[s]) * period // w <= t]
        placed[min(released)[2]].append(t)
    return placed


def reduced(weights: dict[str, int]) -> dict[str, int]:
    common = gcd(*weights.values())
    return {s: w // common for s, w in weights.items()}


def _ranked(docs: DataFrame, group, n: int, carry: list[str]) -> DataFrame:
    """The carried columns, `__group`, and `__rank` of each row in its group by the digest of doc_id, from 0."""
    slices = max(1, -(-n // SLICE_ROWS))
    bits = digest_bits(F.col("doc_id"))
    keyed = (docs.select(*[F.col(f"`{c}`") for c in carry], group.alias("__group"), bits.alias("__bits"))
             .withColumn("__slice", F.shiftright(F.shiftright("__bits", 30) * F.lit(slices).cast("bigint"), 30)))
    # rows before a slice: those of earlier slices in its thousand, and of earlier thousands
    cells = (docs.select(group.alias("__group"), bits.alias("__bits"))
             .select("__group", F.shiftright(F.shiftright("__bits", 30) * F.lit(slices).cast("bigint"), 30).alias("__slice"))
             .groupBy("__group", "__slice").agg(F.count("*").alias("n")).withColumn("super", F.floor(F.col("__slice") / SUPER)))
    before = (W.unboundedPreceding, -1)
    supers = (cells.groupBy("__group", "super").agg(F.sum("n").alias("n"))
              .select("__group", "super", F.coalesce(F.sum("n").over(W.partitionBy("__group").orderBy("super").rowsBetween(*before)), F.lit(0)).alias("outer")))
    within = W.partitionBy("__group", "super").orderBy("__slice").rowsBetween(*before)
    base = (cells.select("__group", "super", "__slice", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inner"))
            .join(supers, ["__group", "super"]).select("__group", "__slice", (F.col("outer") + F.col("inner")).alias("__base")))
    # all groups of a slice lie together, so a frequent group doesn't fill a partition
    ties = [F.col(f"`{c}`") for c in carry if c in ("doc_id", "text")]
    local = F.row_number().over(W.partitionBy("__group", "__slice").orderBy("__bits", *ties))
    ranked = keyed.repartition("__slice").withColumn("__local", local)
    return ranked.join(base, ["__group", "__slice"]).withColumn("__rank", F.col("__base") + F.col("__local") - 1)


def mix(docs: DataFrame, weights: dict[str, int], rest_weight: int = 1, block: int = BLOCK, into: str = "mix") -> DataFrame:
    """Add struct `into`: source_group, block, slot, release, deadline (in slots), position (slot * block + place in the block).

    Weights are whole numbers; all sources that aren't named, and null, together are one group of weight `rest_weight`. Every row gets a
    position and none is dropped or repeated. Positions are unique, rise with the slots and may have gaps. Rows that repeat a doc_id
    follow each other by text where the text is carried. An existing column `into` is replaced, and all others pass through.
    """
    shares = reduced({**weights, REST: rest_weight})
    period = sum(shares.values())
    table = [F.struct(F.lit(s).alias("__group"), F.lit(w).cast("bigint").alias("__weight"), F.array(*map(F.lit, at)).alias("__slots"))
             for (s, w), at in zip(shares.items(), slots(shares).values())]
    names = [c for c in docs.columns if c != into]
    named = F.col("source").isin(*weights) if weights else F.lit(False)
    group = F.when(F.coalesce(named, F.lit(False)), F.col("source")).otherwise(F.lit(REST))
    ranked = _ranked(docs, group, docs.count(), names)
    plan = docs.sparkSession.range(1).select(F.inline(F.array(*table)))  # a row for each weight
    placed = (ranked.join(F.broadcast(plan), "__group").withColumn("__block", F.floor(F.col("__rank") / block))
              .withColumn("__slot", F.floor(F.col("__block") / F.col("__weight")) * period
                          + F.element_at("__slots", (F.col("__block") % F.col("__weight") + 1).cast("int"))))
    made = F.struct(F.col("__group").alias("source_group"), F.col("__block").alias("block"), F.col("__slot").alias("slot"),
                    F.expr(f"__block * {period} div __weight").alias("release"),
                    F.expr(f"((__block + 1) * {period} + __weight - 1) div __weight").alias("deadline"),
                    (F.col("__slot") * block + F.col("__rank") % block).alias("position"))
    return placed.select(*[F.col(f"`{c}`") for c in names], made.alias(into))


def in_mixed_order(docs: DataFrame, weights: dict[str, int], rest_weight: int = 1, block: int = BLOCK) -> DataFrame:
    """The same rows and columns, lying in the order of their positions over and within the partitions."""
    mixed = mix(docs, weights, rest_weight, block, "__mix").withColumn("__position", F.col("__mix.position"))
    return mixed.repartitionByRange("__position").sortWithinPartitions("__position").select(*[F.col(f"`{c}`") for c in docs.columns])
