"""A corpus pipeline: language ID, near-dedup, decontamination, mixing and token output, each stage written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from clipalign.llm import decontaminate, language, mixing, queries, simhash, tokenfiles
from clipalign.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the others go. Learns from the labelled rows of its input that aren't held out."""
    usable = ~F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))
    found = language.predict(docs.select(*COLUMNS), language.learn(docs, usable), into="__language")
    return found.filter("__language.accepted").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group; one without a doc_id stays where the group has no other."""
    return simhash.keep_one(docs.select(*COLUMNS), null_ids=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words lie in benchmark windows."""
    found = decontaminate.find_contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="__hits")
    return found.filter(~decontaminate.is_contaminated("__hits")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the files' order interleaved to the target weights."""
    return mixing.in_mixed_order(docs.select(*COLUMNS), queries.MIX_WEIGHTS, queries.MIX_REST)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix, and from them a row per document: doc_id, start, n_tokens, ids_crc32.

    The order is that of the input's files and of the rows in them. An input without such places is taken by doc_id.
    """
    path = scratch_path(spark, "tokens")
    try:
        docs = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        # file numbers of more than five digits make longer names
        order = [F.length("__file"), F.col("__file"), F.col("__row")]
    except AnalysisException:
        order = None
    tokenfiles.write_tokens(docs, path, public_tokenizers.path(queries.TOKENIZER), order)
    return tokenfiles.with_crc(tokenfiles.read_tokens(spark, path), done=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]

#: The tokenizer and the compressor can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
