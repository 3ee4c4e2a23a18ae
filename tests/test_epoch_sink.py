import json
import os

import pytest
from pyspark.sql import functions as F

from clipalign.sources import epoch_sink as es


def lines(path):
    return sorted((r["epoch"], r["x"]) for name in os.listdir(path) if name[0] not in "._" for r in map(json.loads, open(f"{path}/{name}")))


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "epoch long, x double")


def test_a_repeated_epoch_replaces_its_lines(spark, tmp_path):
    path = f"{tmp_path}/out"
    es.append_epochs(rows(spark, (0, 0.5), (1, 0.25), (None, 9.0)), path)
    es.append_epochs(rows(spark, (1, 0.75), (2, 1.0), (2, 2.0)), f"file:{path}")
    es.append_epochs(rows(spark, (1, 0.75)), path)
    assert sorted(os.listdir(path)) == [f"epoch-{n}.jsonl" for n in ("000000000000", "000000000001", "000000000002", "none")]
    read = spark.read.schema("epoch long, x double").json(path).collect()
    assert sorted((r.epoch if r.epoch is not None else -1, r.x) for r in read) == [(-1, 9.0), (0, 0.5), (1, 0.75), (2, 1.0), (2, 2.0)]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = f"{tmp_path}/out"
    es.append_epochs(rows(spark, (0, 0.5)), path)
    broken = rows(spark, *[(i, float(i)) for i in range(1, 40)]).withColumn(
        "x", F.when(F.col("epoch") == 37, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        es.append_epochs(broken, path)
    assert os.listdir(path) == ["epoch-000000000000.jsonl"] and lines(path) == [(0, 0.5)]


def test_rows_of_an_epoch_stay_together(spark, tmp_path):
    spark.dataSource.register(es.EpochLines)
    parted = rows(spark, *[(1, float(i)) for i in range(8)]).repartition(4)
    with pytest.raises(Exception, match="in one task"):
        parted.write.format("epoch_jsonl").mode("append").save(f"{tmp_path}/out")
    turns = rows(spark, (1, 0.0), (2, 0.0), (1, 1.0)).coalesce(1)
    with pytest.raises(Exception, match="follow each other"):
        turns.write.format("epoch_jsonl").mode("append").save(f"{tmp_path}/out")
    with pytest.raises(Exception, match="no column run"):
        turns.write.format("epoch_jsonl").mode("append").option("key", "run").save(f"{tmp_path}/out")
    assert os.listdir(f"{tmp_path}/out") == []


def test_no_rows_write_nothing(spark, tmp_path):
    es.append_epochs(rows(spark, (1, 1.0)).where("epoch > 1"), f"{tmp_path}/out")
    assert not os.path.isdir(f"{tmp_path}/out") or os.listdir(f"{tmp_path}/out") == []
