"""Every stage of the pipeline against what a plain reading of its rule gives."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from clipalign.llm import mixing, queries

from .test_decontaminate import brute as contamination
from .test_simhash import slow_components, slow_fingerprint

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, each written and read again."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs.collect()]
    folder = tmp_path_factory.mktemp("pipeline")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
        if name != "token_output":
            assert docs.columns == corpus_pipeline.COLUMNS
    return out


def test_language_stage_drops_only_what_it_rejects(spark, stages):
    found = {r.doc_id: r.accepted for r in queries.op7_language_id(spark, SF_DIR).collect()}
    assert {r.doc_id for r in stages[1]} == {i for i, ok in found.items() if ok}
    assert set(stages[1]) <= set(stages[0]) and len(stages[1]) > 0.95 * len(stages[0])


def test_near_dedup_stage_keeps_one_of_each_group(stages):
    ids, fps = [r.doc_id for r in stages[1]], [slow_fingerprint(r.text) for r in stages[1]]
    assert sorted(r.doc_id for r in stages[2]) == sorted(set(slow_components(ids, fps)))
    assert set(stages[2]) <= set(stages[1])


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in stages[3]) == sorted(r.doc_id for r in stages[2] if not contamination(r.text, items)[3])


def test_mixing_stage_keeps_all_and_token_files_follow_its_order(spark, stages, table):
    assert sorted(stages[4]) == sorted(stages[3])
    docs = spark.createDataFrame(stages[3], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    order = [r.doc_id for r in mixing.mix(docs, queries.MIX_WEIGHTS, queries.MIX_REST).orderBy("mix.position").collect()]
    texts = {r.doc_id: r.text for r in stages[3]}
    plain = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    expected, start = [], 0
    for i in order:
        ids = np.array([*plain.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        expected.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[5]) == expected


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF_DIR).collect()) == sorted(stages[5])


@pytest.mark.parametrize("n", range(len(corpus_pipeline.STAGES)))
def test_stages_take_awkward_and_empty_inputs(spark, awkward, table, n):
    name, stage = corpus_pipeline.STAGES[n]
    assert stage(spark, table([]), SF_DIR).count() == 0
    assert stage(spark, awkward, SF_DIR).count() <= awkward.count()
