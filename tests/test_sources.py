import hashlib
import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from clipalign.operators import evaluation as ev, telemetry, text
from clipalign.session import scratch_path
from clipalign.sources import shards as sh, tables as tb
from clipalign.streaming import telemetry as st


def _tar(path, names):
    with tarfile.open(path, "w") as tar:
        for name in names:
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))


@pytest.fixture
def shards(tmp_path):
    _tar(tmp_path / "s-000.tar", ["x/a.mp4", "x/a.TXT", "x/a.jpg", "x/b.png", "x/b.txt", "x/b.txt", "noext", "x/a.webp", "c.MOV"])
    _tar(tmp_path / "s-001.tar", ["d.e.mp4", "d.e.json", "d.txt"])
    (tmp_path / "note.txt").write_text("n")
    return tmp_path


def test_members_keep_stream_order(spark, shards):
    rows = sh.video_index(sh.find_shards(spark, str(shards))).collect()
    assert [(r["shard"][-9:], r["position"], r["member"]) for r in rows] == [
        ("s-000.tar", 0, "x/a.mp4"), ("s-000.tar", 8, "c.MOV"), ("s-001.tar", 0, "d.e.mp4")]
    assert rows[0]["sample_id"].endswith("s-000.tar::x/a.mp4")


def test_no_videos_is_an_error(spark, tmp_path):
    _tar(tmp_path / "s.tar", ["a.txt"])
    with pytest.raises(ValueError, match="no video"):
        sh.video_index(sh.find_shards(spark, str(tmp_path)))


def test_brace_range_and_repeats(spark, shards):
    found = sh.find_shards(spark, f"{shards}/s-{{0..007}}.tar, {shards}/*.tar,{shards}/s-001.tar").collect()
    assert [r["path"][-9:] for r in found] == ["s-000.tar", "s-001.tar"]


def test_samples_split_on_prefix_and_repeated_extension(spark, shards):
    rows = sh.group_samples(sh.find_shards(spark, str(shards))).orderBy("shard", "sample_no").collect()
    got = [(r["key"], sorted(r["members"])) for r in rows]
    assert got == [
        ("x/a", ["jpg", "mp4", "txt"]), ("x/b", ["png", "txt"]), ("x/b", ["txt"]), ("x/a", ["webp"]), ("c", ["mov"]),
        ("d", ["e.json", "e.mp4", "txt"])]
    complete = sh.complete_samples(sh.group_samples(sh.find_shards(spark, str(shards)))).collect()
    assert {(r["key"], r["image"]) for r in complete} == {("x/a", "x/a.jpg"), ("x/b", "x/b.png")}


def test_checksums(spark, shards):
    rows = {r["path"].rsplit("/", 1)[1]: r["md5"] for r in tb.file_checksums(spark, str(shards)).collect()}
    assert rows["note.txt"] == hashlib.md5(b"n").hexdigest() and len(rows) == 3


def test_first_root_owns_a_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.mp4", "in/b.MKV", "in/c.txt"):
        (tmp_path / name).write_bytes(b"x")
    rows = tb.discover_media(spark, [str(tmp_path / "in"), str(tmp_path)]).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["root_no"]) for r in rows} == {("a.mp4", 1), ("b.MKV", 0)}


def test_offset_files_with_and_without_header(spark, tmp_path):
    (tmp_path / "h.csv").write_text("path,offset_sec,vstart_sec\na,0.5,1.5\n")
    (tmp_path / "n.csv").write_text("b,2.5,-0.5,1\n")
    row = tb.read_fixed_offsets(spark, [str(tmp_path / "h.csv")]).head()
    assert row.asDict() == {"path": "a", "offset_sec": 0.5, "v_start_i_sec": 1.5}
    row = tb.read_fixed_offsets(spark, [str(tmp_path / "n.csv")], header=False).head()
    assert row.asDict() == {"path": "b", "v_start_i_sec": 2.5, "offset_sec": -0.5, "oos_target": 1}
    assert tb.fixed_offset_name("test", 21, 5.0, -2.0, 2.0) == "test_size21_crop5_min-2.00_max2.00.csv"
    assert tb.fixed_offset_name("test", None, 4.8, -5.5, 5.5) == "test_unifbin_crop4.8_min-5.50_max5.50.csv"


def test_report_columns_keep_their_order(spark):
    path = scratch_path(spark, "report")
    rows = spark.createDataFrame([("m", 1, None)], "model_name string, top1_correct int, error string")
    tb.write_trials_csv(rows, path)
    read = spark.read.option("header", True).csv(path)
    assert read.columns == ev.TRIAL_FIELDS
    assert read.head()["top1_correct"] == "1" and read.head()["error"] is None


def test_jsonl_appends(spark):
    path = scratch_path(spark, "jsonl")
    for epoch in (0, 1):
        tb.append_results_jsonl(spark.range(1).select(F.lit(epoch).alias("epoch"), F.create_map(F.lit("p"), F.lit(0.5)).alias("metrics")), path)
    lines = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert sorted(l["epoch"] for l in lines) == [0, 1] and lines[0]["metrics"] == {"p": 0.5}


def test_early_stop_state_crosses_batches(spark):
    path = scratch_path(spark, "history")
    values = [("r", 0, 0.1), ("r", 1, 0.3), ("r", 2, 0.2), ("q", 0, 0.0), ("r", 3, 0.25), ("r", 4, 0.9), ("q", 1, 0.0)]
    for row in values:
        spark.createDataFrame([row], "run string, epoch long, metric double").coalesce(1).write.mode("append").parquet(path)
    stream = st.follow_files(spark, path, "run string, epoch long, metric double")
    rows = st.drain(st.running_early_stop(stream, 2, True), "append", "stop").collect()
    got = {(r["run"], r["epoch"]): (r["no_change"], r["triggered"], r["best"]) for r in rows}
    assert got == {
        ("r", 0): (0, False, 0.1), ("r", 1): (0, False, 0.3), ("r", 2): (1, False, 0.3), ("r", 3): (2, True, 0.3),
        ("r", 4): (0, True, 0.9), ("q", 0): (1, False, 0.0), ("q", 1): (2, True, 0.0)}


def test_early_stop_doesnt_depend_on_the_order_of_epochs(spark):
    draw = random.Random(5)
    metrics = {(run, epoch): draw.choice([0.1, 0.2, 0.3, 0.4, draw.random()]) for run in ("hot", "a", "b") for epoch in range(60 if run == "hot" else 9)}
    rows = [(*k, m) for k, m in metrics.items()]
    schema = "run string, epoch long, metric double"
    expected = sorted(map(tuple, telemetry.early_stopping(spark.createDataFrame(rows, schema), 3, False).select(
        "run", "epoch", "metric", "improved", "best", "no_change", "triggered").collect()))
    for shuffle in range(2):
        path = scratch_path(spark, "history")
        draw.shuffle(rows)
        for at in range(0, len(rows), 16):
            # a repeated epoch changes nothing, whether it still waits or is done
            spark.createDataFrame(rows[at:at + 16] + rows[at:at + 2] + rows[:2], schema).coalesce(1).write.mode("append").parquet(path)
        stream = st.follow_files(spark, path, schema)
        got = st.drain(st.running_early_stop(stream, 3, False), "append", "stop").collect()
        assert sorted(map(tuple, got)) == expected


def test_epochs_after_a_gap_wait(spark):
    path = scratch_path(spark, "history")
    schema = "run string, epoch long, metric double"
    spark.createDataFrame([("r", 1, 0.5), ("r", 3, 0.1), ("q", 2, 0.1)], schema).coalesce(1).write.parquet(path)
    rows = st.drain(st.running_early_stop(st.follow_files(spark, path, schema), 2, True, first=1), "append", "stop").collect()
    assert [(r["run"], r["epoch"]) for r in rows] == [("r", 1)]


def test_weighted_components_expand_per_shard(spark):
    rows = sh.expand_weighted(spark, "a-{08..10}.tar::b.tar", "2::0.5").collect()
    assert {r["shard"]: r["weight"] for r in rows} == {"a-08.tar": 2.0, "a-09.tar": 2.0, "a-10.tar": 2.0, "b.tar": 0.5}
    with pytest.raises(ValueError):
        sh.expand_weighted(spark, "a.tar::b.tar", "1")


def test_columns_follow_each_files_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("path,offset_sec,vstart_sec\nx,0.5,3.0\n")
    (tmp_path / "b.csv").write_text("path,v_start_sec,offset_sec,oos_target\ny,4.0,0.25,1\n")
    rows = {r["path"]: r for r in tb.read_fixed_offsets(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"]).collect()}
    assert (rows["x"]["offset_sec"], rows["x"]["v_start_i_sec"], rows["x"]["oos_target"]) == (0.5, 3.0, None)
    assert (rows["y"]["offset_sec"], rows["y"]["v_start_i_sec"], rows["y"]["oos_target"]) == (0.25, 4.0, 1)


def test_only_text_files_are_id_lists(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a\n\nb\n")
    (tmp_path / "table.csv").write_text("path,offset\n")
    assert sorted(r["clip_id"] for r in tb.read_id_lists(spark, str(tmp_path)).collect()) == ["a", "b"]


def test_log_lines_keep_their_order_and_file(spark, tmp_path):
    long = [f"line {i} " + "x" * 200 for i in range(3000)]
    (tmp_path / "long.log").write_text("\n".join(long) + "\n")
    (tmp_path / "short.log").write_text("one\n\nthree\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = tb.read_log(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    read = {name: [r["value"] for r in sorted(rows, key=lambda r: r["line_no"]) if r["file"].endswith(name)] for name in ("long.log", "short.log")}
    assert read == {"long.log": long, "short.log": ["one", "", "three"]}


def test_averages_of_one_log_do_not_touch_another(spark):
    line = "12:00:00 | INFO | Train Epoch: 0 [ {}/10 (5%)] Loss: {}"
    rows = [("a", line.format(1, "2.0 (3.0)")), ("b", line.format(1, "2.0")), ("a", line.format(2, "4.0"))]
    parsed = text.parse_progress(spark.createDataFrame(rows, "file string, value string"))
    assert {(r["file"], r["seen_in_phase"]): r["loss_plot"] for r in parsed.collect()} == {("a", 1): 3.0, ("b", 1): 2.0, ("a", 2): None}


def test_shards_appear_whole_or_not_at_all(spark, tmp_path):
    rows = [("s.tar", i, f"m{i}.txt", bytes([i % 256]) * 5000) for i in range(40)]
    members = spark.createDataFrame(rows, "shard string, position long, member string, content binary")
    sh.write_shards(members, f"{tmp_path}/out").collect()
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["s.tar"]
    index = sh.index_members(sh.find_shards(spark, f"{tmp_path}/out")).orderBy("position").collect()
    assert [(r["member"], r["size"]) for r in index] == [(f"m{i}.txt", 5000) for i in range(40)]
