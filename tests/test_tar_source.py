import io
import tarfile

import pytest
from pyspark.sql import functions as F

from clipalign.sources import tar_source as ts


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Five plain shards and a compressed one, of nine members each."""
    root = tmp_path_factory.mktemp("shards")
    for i in range(6):
        name, mode = (f"s{i}.tar.gz", "w:gz") if i == 5 else (f"s{i}.tar", "w")
        with tarfile.open(root / name, mode) as out:
            out.addfile(tarfile.TarInfo("folder/"), None)
            for k in range(9):
                content = f"{i}:{k} ".encode() * (k * 300)
                info = tarfile.TarInfo(f"d/c{k // 3}.{('MP4', 'txt', 'json')[k % 3]}" if k < 8 else "plain")
                info.size = len(content)
                out.addfile(info, io.BytesIO(content))
    (root / "notes.txt").write_text("no shard")
    return str(root)


def brute(folder):
    for i in range(6):
        path = f"{folder}/s{i}.tar" + (".gz" if i == 5 else "")
        with tarfile.open(path) as t:
            for k, m in enumerate(x for x in t.getmembers() if x.isfile()):
                suffix = m.name.rpartition(".")[2].lower() if "." in m.name else ""
                yield path, k, m.name, suffix, m.size, m.offset_data, suffix == "mp4", t.extractfile(m).read()


def pushed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_members_of_all_shards(spark, folder):
    rows = ts.read_members(spark, folder, ts.WITH_CONTENT).collect()
    assert sorted((*r[:7], bytes(r[7])) for r in rows) == sorted(brute(folder))


@pytest.mark.parametrize("condition, fits", [
    ("suffix = 'txt'", lambda r: r[3] == "txt"), ("suffix in ('mp4', 'json')", lambda r: r[3] in ("mp4", "json")),
    ("shard like '%/s1.tar' and member like 'd/c1%'", lambda r: r[0].endswith("/s1.tar") and r[2].startswith("d/c1")),
    ("member like '%c0%' and size > 0", lambda r: "c0" in r[2] and r[4] > 0), ("not suffix = 'txt'", lambda r: r[3] != "txt"),
    ("suffix = 'txt' and suffix = 'json'", lambda r: False), ("position = 2 or suffix = ''", lambda r: r[1] == 2 or r[3] == "")])
def test_filters(spark, folder, condition, fits):
    rows = ts.read_members(spark, folder).where(condition).collect()
    assert sorted(map(tuple, rows)) == sorted(r[:7] for r in brute(folder) if fits(r))


def test_pushed_filters_leave_the_plan_and_the_shards(spark, folder):
    found = ts.read_members(spark, folder, partition_bytes="1")
    assert found.rdd.getNumPartitions() == 6
    one = found.where(F.col("shard") == f"{folder}/s3.tar").where("suffix = 'json'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 2
    assert "Filter (" not in pushed(one)  # Spark has nothing left to do
    reader = ts.TarReader(folder, found.schema, 1)
    left = list(reader.pushFilters([ts.EqualTo(("suffix",), "txt"), ts.EqualTo(("size",), 3)]))
    assert [f.attribute for f in left] == [("size",)] and len(reader.tests["suffix"]) == 1


def test_fewer_columns_and_patterns(spark, folder):
    rows = ts.read_members(spark, f"{folder}/s[12].tar", "member string, shard string").collect()
    assert sorted(map(tuple, rows)) == sorted((r[2], r[0]) for r in brute(folder) if r[0][-6:] in ("s1.tar", "s2.tar"))
    assert ts.read_members(spark, f"{folder}/none*.tar").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        ts.read_members(spark, f"{folder}/nowhere").collect()


def test_contents_by_place(spark, folder, monkeypatch):
    monkeypatch.setattr(ts, "BATCH_BYTES", 5000)
    members = ts.read_members(spark, f"{folder}/*.tar").where("suffix in ('txt', 'json')").withColumn("c0", F.lit(1))
    rows = ts.read_contents(members).collect()
    assert sorted((r.shard, r.member, bytes(r.content)) for r in rows) == sorted((r[0], r[2], r[7]) for r in brute(folder) if r[3] in ("txt", "json") and r[0].endswith(".tar"))
    lost = ts.read_contents(members.limit(1).withColumn("offset", F.lit(None).cast("bigint"))).head()
    assert lost.content is None and lost.c0 == 1
    assert ts.read_contents(members.where("size < 0")).count() == 0


def test_shards_are_dealt_by_size(spark, folder):
    sizes = dict(ts.list_shards(folder))
    reader = ts.TarReader(folder, ts.read_members(spark, folder).schema, sum(sizes.values()) // 3)
    dealt = [p.paths for p in reader.partitions()]
    assert sorted(x for p in dealt for x in p) == sorted(sizes) and len(dealt) in (3, 4) and all(dealt)
