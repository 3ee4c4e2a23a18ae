"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a digest of doc_id. A bucket that is larger than the byte limit splits on its next bit,
and only such buckets do, so every shard ends with the fewest bits at which it fits. The splits of up to 20 bits are worked out at once
from the sizes of fine cells, and only documents of cells that are still too large are read again with further bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clipalign.session import materialize

#: Bits of the digest, and bits by which one round over the documents refines the directory: a round has at most 2**20 cells.
BITS = 60
ROUND_BITS = 20


def digest_bits(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id's text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def _buckets(sized: DataFrame, depth: int, max_bytes: int) -> DataFrame:
    """d, prefix, shard_bytes, shard_docs and fits of every bucket of up to `depth` bits that has documents."""
    cells = sized.groupBy(F.shiftright("bits", BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
    spread = cells.select("n_bytes", "n", "cell", F.explode(F.sequence(F.lit(depth - ROUND_BITS), F.lit(depth))).alias("d"))
    buckets = (spread.groupBy("d", F.expr(f"shiftright(cell, {depth} - d)").alias("prefix"))
               .agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs")))
    return buckets.withColumn("fits", (F.col("shard_bytes") <= max_bytes) | (F.col("d") == BITS))


def _directory(buckets: DataFrame) -> tuple[int, DataFrame] | None:
    """The bits of the directory, and its entries with their shards; a shard of fewer bits has several entries."""
    split = buckets.filter(~F.col("fits")).select((F.col("d") + 1).alias("d"), F.col("prefix").alias("parent"))
    fitting = buckets.filter("fits")
    under = fitting.withColumn("parent", F.shiftright("prefix", 1)).join(split, ["d", "parent"], "left_semi").drop("parent")
    shards = materialize(under.unionByName(fitting.filter("d = 0")))
    bits = shards.agg(F.max("d")).first()[0]
    if bits is None:
        return None
    entries = F.explode(F.expr(f"sequence(shiftleft(prefix, {bits} - d), shiftleft(prefix + 1, {bits} - d) - 1)"))
    return bits, shards.select(entries.alias("__entry"), F.struct(F.col("d").alias("depth"), "shard_bytes", "shard_docs").alias("__found"))


def assign_shards(docs: DataFrame, max_bytes: int, into: str = "shard") -> DataFrame:
    """Add struct `into`: shard (its leading bits as text), depth, shard_bytes, shard_docs.

    Sizes are bytes of text; null and empty texts have none. A null doc_id has the digest of an empty text. Rows that repeat a doc_id
    can't be parted: they share a shard, and if they alone are larger than `max_bytes` the shard has all 60 bits and shows its size. An
    existing column `into` is replaced, and all others pass through.
    """
    names = [c for c in docs.columns if c != into]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], digest_bits(F.col("doc_id")).alias("__bits"))
    sized = docs.select(digest_bits(F.col("doc_id")).alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    shard = F.lit(None).cast("struct<depth int, shard_bytes bigint, shard_docs bigint>")
    for depth in range(ROUND_BITS, BITS + 1, ROUND_BITS):
        buckets = materialize(_buckets(sized, depth, max_bytes))
        directory = _directory(buckets)
        if directory:
            found = f"__shard{depth}"
            rows = rows.join(directory[1].withColumnRenamed("__found", found), F.shiftright("__bits", BITS - directory[0]) == F.col("__entry"), "left")
            rows = rows.drop("__entry")
            shard = F.coalesce(shard, F.col(found))
        large = buckets.filter(~F.col("fits") & (F.col("d") == depth)).select("prefix")
        if large.isEmpty():
            break
        sized = sized.join(large, F.shiftright("bits", BITS - depth) == F.col("prefix"), "left_semi")
    bits = F.lpad(F.bin("__bits"), BITS, "0")
    filled = rows.withColumn("__shard", shard)
    made = F.struct(F.substring(bits, F.lit(1), F.col("__shard.depth")).alias("shard"), F.col("__shard.depth").cast("bigint").alias("depth"),
                    "__shard.shard_bytes", "__shard.shard_docs")
    return filled.select(*[F.col(f"`{c}`") for c in names], made.alias(into))


def write_shards(docs: DataFrame, max_bytes: int, path: str) -> None:
    """Write the documents as Parquet, one folder for each shard."""
    placed = assign_shards(docs, max_bytes, "__shard").withColumn("shard", F.concat(F.lit("b"), "__shard.shard")).drop("__shard")
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
